"""Language identification by compression with one zstandard dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.tables import crc_of_id, unused_name
from blockloom.session import broadcast_if_bounded, materialized

LETTERS = re.compile(r"[^\W\d_]+")
BLOCK_BYTES = 4096
RANK_SALTS = 64
SHORT_BYTES = 64
UNKNOWN = "und"


def words_only(text: str | None) -> bytes:
    """Lower-case letters of a text with one space between words, in UTF-8."""
    return " ".join(LETTERS.findall((text or "").lower())).encode("utf-8", "replace")


def learn_dictionaries(
    labelled: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    sample_docs: int = 256,
    sample_bytes: int = 4096,
    dictionary_bytes: int = 131072,
) -> dict[str, bytes]:
    """Raw-content dictionary of every language with labelled rows.

    The sample has a stated bound: at most ``sample_docs`` distinct texts per language, those
    with the smallest hash, of each at most ``sample_bytes`` bytes of letters from its middle,
    and the last ``dictionary_bytes`` of their joined letters. Texts of any length may teach;
    those under ``SHORT_BYTES`` bytes fill the places that longer ones leave. Copies are
    brought together before the rank, which sees hashes alone and is limited in every map
    task, so no language is gathered in one task. A text that the other half of the sample
    takes for another language is left out as mislabelled, unless that half has less than
    ``BLOCK_BYTES`` of the text's own language to judge by. Rows without language or letters,
    and languages with fewer than the 8 bytes of letters a dictionary needs, teach nothing.
    """
    rows = labelled.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("at"))
    rows = rows.filter("lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    chosen = rows.select("lang", "at", (F.octet_length("text") < SHORT_BYTES).alias("short")).dropDuplicates(["lang", "at"])
    chosen = chosen.withColumn("salt", F.pmod("at", F.lit(RANK_SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # so one language's candidates do not meet at once
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("short", "at"))
        chosen = chosen.withColumn("nth", rank).filter(F.col("nth") <= sample_docs)
    chosen = broadcast_if_bounded(materialized(chosen.select("lang", "at", "nth"), "chosen"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[_middle(text, sample_bytes) for text in batch["text"]])

    pieces = rows.join(chosen, ["lang", "at"]).select("lang", "at", "nth", "text")
    pieces = pieces.mapInPandas(cut, "lang string, at long, nth int, text string").dropDuplicates(["lang", "at"])
    seen: dict[str, str] = {}
    for row in pieces.orderBy("lang", "nth").select("lang", "text").collect():
        seen.setdefault(row.text, row.lang)
    halves = list(seen.items())[::2], list(seen.items())[1::2]
    trusted = []
    for own, other in (halves, halves[::-1]):
        known = _joined(other, dictionary_bytes)
        judge = Compressors(known, level=3)
        thin = {lang for _, lang in own if len(known.get(lang, b"")) < BLOCK_BYTES}
        trusted += [(text, lang) for text, lang in own if lang in thin or judge.best(text)[0] == lang]
    return _joined(trusted, dictionary_bytes)


def _middle(text: str, size: int) -> str:
    """At most ``size`` bytes from the middle of a text's letters."""
    letters = words_only(text)
    start = max(0, (len(letters) - size) // 2)
    return letters[start : start + size].decode("utf-8", "ignore")


def _joined(sample: list[tuple[str, str]], dictionary_bytes: int) -> dict[str, bytes]:
    parts: dict[str, list[bytes]] = {}
    for text, lang in sample:
        parts.setdefault(lang, []).append(words_only(text))
    joined = {lang: b" ".join(texts)[-dictionary_bytes:] for lang, texts in parts.items()}
    return {lang: content for lang, content in joined.items() if len(content) >= 8}


class Compressors:
    """Sizes of a text under every dictionary; blocks keep the dictionary in reach to the end."""

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.langs = sorted(dictionaries)
        self.frames = []
        for lang in self.langs:
            known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            options = {"write_content_size": False, "write_dict_id": False}
            self.frames.append(zstandard.ZstdCompressor(level=level, dict_data=known, **options))

    def best(self, text: str | None) -> tuple[str, float]:
        """Language of the smallest encoding and its margin over the second, as a share."""
        content = words_only(text)
        if not content or not self.langs:
            return UNKNOWN, 0.0
        blocks = [content[at : at + BLOCK_BYTES] for at in range(0, len(content), BLOCK_BYTES)]
        sizes = [sum(len(frame.compress(block)) for block in blocks) for frame in self.frames]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        second = sizes[order[1]] if len(order) > 1 else len(content) + 1
        return self.langs[order[0]], max(0.0, min(1.0, (second - sizes[order[0]]) / second))


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text_column: str = "text", min_margin: float = 0.004, level: int = 3
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_rejected``.

    ``score`` is the margin between the smallest and the second encoding. A text is rejected
    if the margin is under ``min_margin`` or if it has no letter; the latter, null and empty
    texts are ``und`` with score 0. A tie goes to the first name and is rejected. Whole
    texts are read, one at a time. Columns of these names are replaced.
    """
    text, kept = F.col(text_column), [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_rejected")]
    found = unused_name(docs, "_found")

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(dictionaries, level)
        for batch in texts:
            yield pd.DataFrame([compressors.best(t) for t in batch], columns=["lang_pred", "score"])

    rows = docs.select(*kept, predict(text).alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")
    return rows.withColumn("lang_rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin))


def held_out(doc_id: str = "doc_id"):
    return crc_of_id(doc_id) % 3 == 1


def learn_from_documents(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the labelled documents that are not held out."""
    return learn_dictionaries(docs.filter(~held_out()))
