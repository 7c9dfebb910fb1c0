"""Main text of web pages: block costs as terminals of a graph, separated by a minimum cut."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.min_cut import Cut
from blockloom.llm.page_blocks import Block, Place, blocks_of, free_wrappers, places_of
from blockloom.llm.tables import unused_name

UNIT = 1000  # capacities are whole thousandths


@dataclass(frozen=True)
class Weights:
    """Log odds that a block is content, and the smoothness of neighbouring labels.

    What a block says and where it stands among the page's words decides; names are one weak
    sign among others. Smoothness is of the size of the odds, so a short paragraph among
    long ones takes their label.
    """

    words: float = 0.8  # times the logarithm of one more than the words
    usual: float = -0.9  # times that of the page's usual block, the mean over its running words
    least: float = -3.6  # of the latter
    linked: float = -4.0  # times the share of words inside links
    share: float = 3.0  # times the share of the page's running words around the block
    strange: float = -4.0  # times how little of the main box the block's own layout box holds
    outside: float = -1.5  # outside an article that has most running words
    heading: float = 0.5
    kind: float = -8.0  # hidden, or inside a menu, footer, aside, form by tag or role
    name: float = -3.0  # inside an element whose class or id says so
    header: float = -5.0  # headers outside articles
    adjacent: float = 1.5  # blocks that follow each other
    proximity: float = 3.0  # blocks with a near common ancestor


def content_odds(block: Block, place: Place, weights: Weights) -> float:
    odds = max(weights.least, weights.usual * math.log1p(place.usual)) + weights.words * math.log1p(place.words)
    odds += weights.linked * min(1.0, block.linked / max(place.words, 1))
    odds += weights.share * place.share + weights.strange * place.strange + weights.heading * block.heading
    odds += weights.outside * place.outside
    if block.apart:
        odds += weights.kind if block.apart_by_kind else weights.name
    return odds + weights.header * (block.header and not place.article)


def _costs(odds: float) -> tuple[int, int]:
    """Costs of calling a block boilerplate and content: negative logarithms of the odds' chances."""
    softplus = max(odds, 0.0) + math.log1p(math.exp(-abs(odds)))
    return round(UNIT * softplus), round(UNIT * (softplus - odds))


def _distance(one: tuple[int, ...], two: tuple[int, ...]) -> int:
    """Steps between two places of the document tree."""
    common = 0
    for a, b in zip(one, two):
        if a != b:
            break
        common += 1
    return len(one) + len(two) - 2 * common


def label_blocks(blocks: list[Block], texts: list[str], weights: Weights) -> tuple[list[bool], list[bool]]:
    """Whether each block is content, by the cheapest labelling of the whole page, and
    whether its own odds alone would have said so.

    Neighbours in the text are joined, and every block with the one before it under the
    same parent; each step more between them in the document tree halves the strength.
    """
    words = [len(text.split()) for text in texts]
    free_wrappers(blocks, words)
    graph, sibling, alone = Cut(len(blocks)), {}, []
    for i, (block, place) in enumerate(zip(blocks, places_of(blocks, words))):
        odds = content_odds(block, place, weights)
        alone.append(odds > 0)
        graph.terminals(i, *_costs(odds))
        joined = {i - 1: weights.adjacent} if i else {}
        parent = block.path[:-1]
        if parent in sibling:
            joined[sibling[parent]] = joined.get(sibling[parent], 0.0) + weights.proximity
        for other, weight in joined.items():
            room = round(UNIT * weight / 3 * 2.0 ** (2 - _distance(block.path, blocks[other].path)))
            graph.edge(i, other, room, room)
        sibling[parent] = i
    return graph.source_side(), alone


def main_text(html: str | None, weights: Weights = Weights()) -> tuple[str, int, int]:
    """Main text, number of blocks and number of content blocks of one page."""
    blocks = blocks_of(html)
    texts = [" ".join("".join(block.text).split()) for block in blocks]
    labels, _ = label_blocks(blocks, texts, weights)
    kept = [text for text, content in zip(texts, labels) if content and text]
    return " ".join(kept), len(blocks), len(kept)


def extract_pages(pages: DataFrame, html_column: str = "html", weights: Weights = Weights()) -> DataFrame:
    """``pages`` without the html column and with ``text, n_chars, n_blocks, n_content_blocks``.

    Every page is read whole and by itself. Null or empty html, and pages without content,
    give empty text. Rows may repeat; columns with the new names are replaced.
    """
    names = ("text", "n_chars", "n_blocks", "n_content_blocks")
    kept = [c for c in pages.columns if c.lower() not in (*names, html_column.lower())]

    @F.pandas_udf("text string, n_blocks long, n_content_blocks long")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([main_text(html, weights) for html in batch], columns=["text", "n_blocks", "n_content_blocks"])

    own = unused_name(pages, "_extracted")
    found = pages.withColumn(own, extract(F.col(html_column)))
    text = F.col(f"{own}.text")
    return found.select(*kept, text, F.length(text).cast("long").alias("n_chars"), f"{own}.n_blocks", f"{own}.n_content_blocks")
