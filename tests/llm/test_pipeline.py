"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import re

import public_tokenizers
from llm_rows import SCHEMA, corpus, no_docs  # noqa: F401
from test_dedup import near_brute, plain
from test_scans import spans_brute
from test_tokens import check_packing

import __spark_entry__ as entry
import corpus_pipeline
from blockloom.llm.language_id import Compressors, learn_dictionaries
from blockloom.session import materialized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write_table(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    odd = spark.createDataFrame(corpus(), SCHEMA).selectExpr("doc_id + 1000 AS doc_id", "text", "'en' AS lang", "source", "n_chars")
    rows = docs.select(*COLUMNS).unionByName(odd)
    rows.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def without(text):
    spans, out, end = spans_brute(text), [], 0
    for a, _, b, _ in spans:
        if a > end or not out:
            out.append(text[end:a])
        end = max(end, b)
    return "[SECRET]".join([*out, text[end:]]) if spans else text


def test_stages_equal_brute_force(spark, folder):
    docs = write_table(spark, folder)
    judge = Compressors(learn_dictionaries(docs), 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    verdicts = {text: judge.best(text) for _, text in rows}
    rows = [r for r in rows if verdicts[r[1]][0] != "und" and verdicts[r[1]][1] >= 0.004]
    found, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        found = materialized(stage(spark, found, folder), name)
        got = sorted(str((r.doc_id, r["text"])) for r in found.collect()) if "text" in found.columns else None
        if name == "exact_dedup":
            first = {}
            for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
                first.setdefault(plain(text), (doc_id, text))
            rows = list(first.values())
        elif name == "near_dedup":
            classes = near_brute(rows, 5, 80)
            rows = [r for r in rows if r[0] is None or classes[r[0]] == r[0]]
        elif name == "secret_scan":
            rows = [(i, without(t)) for i, t in rows]
        if got is not None:
            assert found.columns == COLUMNS
            assert got == sorted(map(str, rows)), name
            kept.append(len(rows))
    assert kept[0] > kept[1] > kept[2] == kept[3]
    check_packing(found.collect(), rows, 2048)
    same = corpus_pipeline.run(spark, folder)
    assert sorted(str(tuple(r)[:5]) for r in same.collect()) == sorted(str(tuple(r)[:5]) for r in found.collect())


def test_pipeline_is_registered_and_takes_an_empty_table(spark, folder):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    assert entry.queries()["pipeline"](spark, folder).count() == 0
    assert "pipeline" not in entry.oracle_sql()


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_tokenizer_files_are_read_in_place():
    assert hashlib.sha256(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()).hexdigest()
    assert corpus_pipeline.tokenizer_file("word_bpe_49k.json") == public_tokenizers.path("word_bpe_49k.json")
