"""Benchmark passages in documents, found by pieces and verified by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import frugal, small_batches, without

#: Edits allowed, as a share of the item's length.
ERROR_RATE = 0.1
#: Items are searched in blocks of up to so many characters, one pass over the documents each.
BLOCK_CHARS = 1 << 22
RESULT = ("leaked", "leaks")
LEAKS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def folded(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split()) if text else ""


def distance_within(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a part of ``text``, and where that part ends.

    Bit-parallel: a column of the distance matrix is two bit vectors, which take a
    few word operations for each character of the text. None if over ``budget``.
    """
    m = len(pattern)
    places: dict[str, int] = {}
    for i, sign in enumerate(pattern):
        places[sign] = places.get(sign, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, sign in enumerate(text):
        equal = places.get(sign, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        grow = minus | (full & ~(across | plus))
        shrink = plus & across
        if grow & high:
            score += 1
        elif shrink & high:
            score -= 1
        grow, shrink = grow << 1 & full, shrink << 1 & full  # a match may begin anywhere
        plus = shrink | (full & ~(vertical | grow))
        minus = grow & vertical
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= budget else None


GRAM = 3


def grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


def may_match(own: frozenset[str], window: str, least: int) -> bool:
    """Whether enough of the window's n-grams are in the item at all.

    An edit changes up to GRAM of an item's n-grams, so a part of the window within
    the budget still has the others; a window that fails needs no distance.
    """
    return least <= 0 or sum(map(own.__contains__, grams(window))) >= least


def pieces(text: str, count: int) -> list[tuple[int, str]]:
    """``text`` in ``count`` parts of nearly equal length, with their places."""
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [(a, text[a:z]) for a, z in zip(cuts, cuts[1:])]


@dataclass
class Items:
    """Items of a block and an automaton of their pieces."""

    texts: list[str]
    ids: list[list[int | None]]
    budgets: list[int]
    own: dict[int, frozenset[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], rate: float) -> Items:
        ids: dict[str, list[int | None]] = {}
        for item, text in rows:
            if text:
                ids.setdefault(text, []).append(item)
        texts = sorted(ids)
        return cls(texts, [sorted(ids[t], key=lambda x: (x is None, x or 0)) for t in texts],
                   [int(len(t) * rate) for t in texts])

    def automaton(self):
        import ahocorasick

        where: dict[str, list[tuple[int, int]]] = {}
        for k, (text, budget) in enumerate(zip(self.texts, self.budgets)):
            for at, piece in pieces(text, budget + 1):
                where.setdefault(piece, []).append((k, at))
        machine = ahocorasick.Automaton()
        for piece, places in where.items():
            machine.add_word(piece, (len(piece), places))
        machine.make_automaton()
        return machine

    def search(self, machine, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, end) of the best place of each item within its budget.

        If an item is within its budget, one of its pieces is unchanged there, since
        there are more pieces than edits; so nothing is missed. Places that pieces
        point to are merged to windows, and each window is verified once.
        """
        hits: dict[int, set[int]] = {}
        for last, (size, places) in machine.iter(text):
            begin = last + 1 - size
            for k, at in places:
                hits.setdefault(k, set()).add(begin - at)
        found = []
        for k, begins in hits.items():
            pattern, budget = self.texts[k], self.budgets[k]
            m, best = len(pattern), None
            if k not in self.own:
                self.own[k] = frozenset(grams(pattern))
            least = m - GRAM + 1 - GRAM * budget
            windows: list[list[int]] = []
            for begin in sorted(begins):
                a, z = max(0, begin - budget), min(len(text), begin + m + budget)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(z, windows[-1][1])
                else:
                    windows.append([a, z])
            for a, z in windows:
                if not may_match(self.own[k], text[a:z], least):
                    continue
                got = distance_within(pattern, text[a:z], budget)
                if got and (best is None or got[0] < best[0]):
                    end = a + got[1]
                    # Backwards from the end gives the start of the same match.
                    back = distance_within(pattern[::-1], text[max(0, end - m - budget) : end][::-1], budget)
                    best = (got[0], end - (back or got)[1], end)
            if best:
                found += [(item, *best) for item in self.ids[k]]
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Items in blocks of a bounded size, read one after the other."""
    block, size = [], 0
    for row in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        text = folded(row[1])
        block.append((row[0], text))
        size += len(text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with ``leaked`` and ``leaks``, the items found in each document.

    An item leaks if some part of the whole text is within ``error_rate`` times its
    length in edits of it, both in lower case with single spaces; ``start`` and
    ``end`` are places in that form of the text. Each item is cut into one more
    piece than it has edits, exact pieces are searched, and the places they point to
    are verified by bit-parallel edit distance. Documents are not shuffled. Items go
    to the tasks in blocks of ``block_chars`` characters; more items take more
    passes.

    Null or blank items match nothing. Null and blank texts leak nothing. Items with
    the same text are all reported; a null item id is reported as null. Repeated
    rows are judged alike, empty tables give empty results or no leaks, and input
    columns named like a result column are replaced.
    """
    docs = small_batches(without(docs, RESULT))
    out = docs.withColumn("leaks", F.expr(f"cast(array() as {LEAKS})"))
    for block in item_blocks(items, item_id, item_text, block_chars):
        out = _search(out, text_col, Items.of(block, error_rate))
    order = F.array_sort("leaks")
    return out.withColumns({"leaks": order, "leaked": F.size("leaks") > 0})


def _search(docs: DataFrame, text_col: str, block: Items) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)
    place, found_at = docs.columns.index(text_col), docs.columns.index("leaks")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        machine = known.automaton()
        keys = ("item_id", "distance", "start", "end")
        for batch in batches:
            before = batch.column(found_at)
            after = before.to_pylist()
            for i, text in enumerate(batch.column(place)):
                text = folded(text.as_py())
                if text and known.texts:
                    after[i] = after[i] + [dict(zip(keys, x)) for x in known.search(machine, text)]
            columns = list(batch.columns)
            columns[found_at] = pa.array(after, before.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(frugal(task), docs.schema)
