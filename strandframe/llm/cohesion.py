"""Splitting long texts where their vocabulary changes.

Blocks of sentences slide over the text; the cosine of the word counts before and after a sentence border, weighted by how
rare a word is in the text, tells how much of the vocabulary goes on. The curve is smoothed, and a valley's depth is how far it
rises again on both sides. Borders with their depths go to ``windows``: within each size window the deepest valley at the end of
a paragraph is cut, else the deepest within one, the farther of equal ones, and the next piece starts a fixed overlap before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.windows import split_items
from strandframe.session import cut

#: Sentences in a block on either side of a border.
BLOCK = 20

_BORDER = re.compile(r"[.!?]+[\"')\]]*\s+|[。！？]+\s*|\n\s*")
_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; together they are the text."""
    ends = [m.end() for m in _BORDER.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def words(sentence: str) -> list[str]:
    """Lower-case words and numbers; of scripts written without blanks the pairs of letters."""
    out = []
    for w in _WORD.findall(sentence.lower()):
        if _WIDE.search(w):
            out.extend(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        else:
            out.append(w)
    return out


def weights(units: list[list[str]]) -> dict[str, float]:
    """Squared rarity of each word within the text; 0 for a word of one unit, which links nothing."""
    held = Counter(w for u in units for w in set(u))
    return {w: log(len(units) / n) ** 2 if n > 1 else 0.0 for w, n in held.items()}


def similarities(units: list[list[str]], block: int = BLOCK) -> list[float]:
    """Cosine of the weighted word counts of the ``block`` units before and after each inner border, all in one pass."""
    weight = weights(units)
    units = [[w for w in u if weight[w]] for u in units]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = nl = nr = 0.0
    for u in units[:block]:
        for w in u:
            n = right.get(w, 0)
            nr += (2 * n + 1) * weight[w]
            right[w] = n + 1
    out = []
    for i in range(1, len(units)):
        for w in units[i - 1]:  # from right to left
            r, lf, k = right[w], left.get(w, 0), weight[w]
            dot += ((r - 1) * (lf + 1) - r * lf) * k
            nr -= (2 * r - 1) * k
            nl += (2 * lf + 1) * k
            right[w], left[w] = r - 1, lf + 1
        if i - 1 - block >= 0:
            for w in units[i - 1 - block]:
                lf, k = left[w], weight[w]
                dot -= right.get(w, 0) * k
                nl -= (2 * lf - 1) * k
                left[w] = lf - 1
        if i - 1 + block < len(units):
            for w in units[i - 1 + block]:
                r, k = right.get(w, 0), weight[w]
                dot += left.get(w, 0) * k
                nr += (2 * r + 1) * k
                right[w] = r + 1
        out.append(max(0.0, dot) / sqrt(nl * nr) if nl > 1e-9 and nr > 1e-9 else 0.0)
    return out


def smooth(sims: list[float]) -> list[float]:
    """Mean of each value and its neighbours."""
    return [sum(near) / len(near) for i in range(len(sims)) if (near := sims[max(0, i - 1) : i + 2])]


def depths(sims: list[float]) -> list[float]:
    """How far the similarity climbs from each border to the next peaks on both sides."""
    n = len(sims)
    up_left, up_right = [0.0] * n, [0.0] * n
    for i in range(n):
        up_left[i] = up_left[i - 1] if i and sims[i - 1] >= sims[i] else sims[i]
        j = n - 1 - i
        up_right[j] = up_right[j + 1] if j + 1 < n and sims[j + 1] >= sims[j] else sims[j]
    return [a + b - 2 * s for a, b, s in zip(up_left, up_right, sims, strict=True)]


def _paragraph(text: str, at: int) -> bool:
    """Whether an empty line lies before ``at``."""
    i = at
    while i and text[i - 1].isspace():
        i -= 1
    return text.count("\n", i, at) > 1


def borders(text: str, block: int = BLOCK) -> list[tuple[int, int, float]]:
    """(place, level, depth) of every inner sentence border: level 1 at the end of a paragraph, else 0."""
    spans = sentences(text)
    deep = depths(smooth(similarities([words(text[a:b]) for a, b in spans], block)))
    return [(end, int(_paragraph(text, end)), d) for (_, end), d in zip(spans[:-1], deep, strict=True)]


def valleys(docs: DataFrame, doc: str, text: str, limit: int, block: int = BLOCK) -> DataFrame:
    """(item, doc, pos, level, depth): the borders of every text longer than ``limit`` letters, and its end at level -1.

    ``item`` numbers the rows; it holds once the result is written. A text is looked at by one task as a whole."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item = TaskContext.get().partitionId() << 40
        for p in parts:
            rows = []
            for d, t in zip(p["_d"], p["_t"], strict=True):
                rows += [(item, d, *b) for b in [*borders(t, block), (len(t), -1, 0.0)]]
                item += 1
            yield pd.DataFrame(rows, columns=["item", "doc", "pos", "level", "depth"])

    return docs.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).where(F.length("_t") > limit).mapInPandas(run, f"item long, doc {kind}, pos long, level int, depth double")


def split_texts(docs: DataFrame, doc: str, text: str, limit: int, overlap: int, block: int = BLOCK) -> DataFrame:
    """(doc, piece_no, piece_start, piece_end) of texts longer than ``limit`` letters; others, null or empty give no row.

    Repeated rows are split each."""
    found = cut(valleys(docs, doc, text, limit, block))
    ends = found.where("level = -1")
    items = ends.select(F.col("item").alias("job"), F.col("item").alias("seq"), F.lit(0).alias("start"), F.col("pos").alias("end"))
    pieces = split_items(items, found.where("level >= 0").select(F.col("item").alias("seq"), "pos", "level", "depth"), limit, overlap)
    number = (F.row_number().over(Window.partitionBy("job").orderBy("piece_start")) - 1).alias("piece_no")
    pieces = pieces.select("job", number, F.col("piece_start").cast("int").alias("piece_start"), F.col("piece_end").cast("int").alias("piece_end"))
    return pieces.join(ends.select(F.col("item").alias("job"), F.col("doc").alias("_doc")), "job").select(F.col("_doc").alias(doc), "piece_no", "piece_start", "piece_end")
