"""Evaluation texts leaking into training text.

Method: q-gram lemma filtering. Texts are folded to a string of letters and digits. A passage of an item that
stands in a document with few word edits shares at least a computable number of character q-grams with it, all in
a narrow band of diagonals. Shared q-grams are counted in overlapping bands; regions that reach the item's bound are
verified by an alignment of words within the band.

Diagonals are counted in words (word of the document less word of the item), not in characters: an inserted word shifts
them by one, however long it is. The width of the bands follows from the edit budget, q is for each item the greatest
one that its bound is positive for, and of a q-gram that stands in a band several times one counts, so the filter
loses no case and passes few others.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlytics.session import Written

#: Items that are held in an index in every task; with more, their q-grams stay in a table that documents are joined with.
ITEM_BLOCK = 20_000
#: Bytes of folded text scanned at once; bounds the memory of a task, not what is found.
SCAN_BLOCK = 1 << 20
#: Sizes of q-grams to choose from, the greatest that gives a bound; with 2 every item has one.
GRAMS = (8, 6, 4, 3, 2)
#: Bits of the map of q-grams that occur in items: in an index, and at most where they stay in a table.
_BITS, _TABLE_BITS = 22, 27
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DELETE = bytes(c for c in range(256) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")
_QUOTES = re.compile("['’‘ʼ`´′]")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_WORD = re.compile(r"[^\W_]+")


def _undo_mojibake(match: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return match[0].encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return match[0]


def _without_comments(text: str) -> str:
    kept, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        kept.append(text[at:start])
        at = stop + 3
    return " ".join([*kept, text[at:]])


def fold(text: str) -> str:
    """Lower-case text in which markup, entities, escapes, accents, quotes and invisible characters are resolved."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", _without_comments(text))
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "%" in text and _PERCENT.search(text):
        text = unquote(text)
    if not text.isascii():
        text = _MOJIBAKE.sub(_undo_mojibake, text)
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _QUOTES.sub("", text.lower())


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def squeezed(text: str) -> bytes:
    """The folded text without anything but letters and digits."""
    if text.isascii() and not ("&" in text or "<" in text or "\\" in text or "%" in text):
        return text.encode("ascii").translate(_LOWER, _DELETE)
    folded = fold(text)
    if folded.isascii():
        return folded.encode("ascii").translate(_LOWER, _DELETE)
    return "".join(_WORD.findall(folded)).encode("utf-8", "replace")


def gram_codes(data: bytes, q: int) -> np.ndarray:
    """Every run of q bytes as an integer (q <= 8)."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    codes = np.ndarray((len(data) - q + 1,), "<u8", data + bytes(8), 0, (1,)).astype(np.uint64)
    return codes if q == 8 else codes & np.uint64((1 << 8 * q) - 1)


def lemma_bounds(items: list[list[int]], least: int, edits: int, q: int) -> np.ndarray:
    """For each item, the fewest q-grams that any ``least`` consecutive words keep when ``edits`` are altered.

    An item is given by its words' lengths in bytes and has at least ``least`` words. An altered word takes with it
    every q-gram that touches it, and a dropped or an inserted word no more than an altered one, so this bounds
    all edits from below.
    """
    windows, owner = [], []
    for k, lengths in enumerate(items):
        ends = np.concatenate([[0], np.cumsum(lengths)])
        windows.append(np.lib.stride_tricks.sliding_window_view(ends, least + 1))
        owner += [k] * len(windows[-1])
    at = np.ascontiguousarray(np.concatenate(windows).T)
    lowest = np.full(at.shape[1], np.iinfo(np.int64).max)
    for cut in itertools.combinations(range(least), edits):
        borders = itertools.pairwise([-1, *cut, least])
        lowest = np.minimum(lowest, sum(np.maximum(0, at[b] - at[a + 1] - q + 1) for a, b in borders))
    bounds = np.full(len(items), np.iinfo(np.int64).max)
    np.minimum.at(bounds, owner, lowest)
    return bounds


def budget(least: int, one_in: int) -> int:
    """The most edits that some ``least`` consecutive words of every passage have: with more in each, the whole passage
    would have more than one in ``one_in``."""
    return least // one_in + 1


def spread(least: int, one_in: int) -> int:
    """How far the diagonals of such words may lie apart: an inserted or dropped word shifts them by one, and so does a
    word that is written apart or together."""
    return least + budget(least, one_in) + 1


def reach(least: int, one_in: int) -> int:
    """How many words a passage may go on before or after ``least`` of its words, in the item or in the document.

    A passage of twice ``least`` words or more always has a shorter one in it (cut it after a multiple of ``one_in`` words:
    one of the parts keeps to the budget), so less than ``least`` words are left of it, each of which may be written apart.
    """
    return 2 * least + 2 * budget(least, one_in)


@dataclass
class ItemIndex:
    """The q-grams of items that share a q, with each item's bound, and each q-gram's place and the word it begins in."""

    ids: list
    words: list[list[str]]
    bounds: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    word: np.ndarray
    least: int
    one_in: int
    q: int

    def filter_map(self) -> np.ndarray:
        there = np.zeros(1 << _BITS, bool)
        there[(self.grams * _SPREAD) >> np.uint64(64 - _BITS)] = True
        return there


def bounded(items: list[tuple], least: int, one_in: int) -> Iterator[tuple[int, list[tuple]]]:
    """(q, [(id, words, bound)]) of the items (id, text) that have at least ``least`` words."""
    left = [(i, w) for i, t in items if t is not None and len(w := words(t)) >= least]
    edits = budget(least, one_in)
    for q in GRAMS:
        if left:
            bounds = lemma_bounds([[len(x.encode()) for x in w] for _, w in left], least, edits, q)
            taken = [(i, w, int(b)) for (i, w), b in zip(left, bounds, strict=True) if b > 0 or q == GRAMS[-1]]
            left = [x for x, b in zip(left, bounds, strict=True) if b <= 0 and q != GRAMS[-1]]
            if taken:
                yield q, taken


def placed_grams(item: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """The q-grams of an item and the word each begins in."""
    parts = [w.encode() for w in item]
    codes = gram_codes(b"".join(parts), q)
    return codes, np.repeat(np.arange(len(parts)), [len(p) for p in parts])[: len(codes)]


def build_indexes(items: list[tuple], least: int, one_in: int) -> list[ItemIndex]:
    out = []
    for q, kept in bounded(items, least, one_in):
        grams = [placed_grams(w, q) for _, w, _ in kept]
        every = np.concatenate([c for c, _ in grams])
        item = np.repeat(np.arange(len(kept)), [len(c) for c, _ in grams])
        place = np.concatenate([np.arange(len(c)) for c, _ in grams])
        word = np.concatenate([w for _, w in grams])
        order = np.argsort(every, kind="stable")
        one, starts = np.unique(every[order], return_index=True)
        out.append(ItemIndex(
            [i for i, _, _ in kept], [w for _, w, _ in kept], np.maximum(1, [b for _, _, b in kept]), one,
            np.append(starts, len(every)), item[order], place[order], word[order], least, one_in, q,
        ))
    return out


def shared_grams(index: ItemIndex, there: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place in it, item, place in the item, word of the item) of every q-gram that a text shares with an item."""
    codes = gram_codes(b"".join(texts), index.q)
    if not len(codes):
        return (np.empty(0, np.int64),) * 5
    maybe = np.flatnonzero(there[(codes * _SPREAD) >> np.uint64(64 - _BITS)])
    found = codes[maybe]
    slot = np.searchsorted(index.grams, found)
    slot[slot == len(index.grams)] = 0
    real = index.grams[slot] == found
    maybe, slot = maybe[real], slot[real]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text = np.searchsorted(begins, maybe, side="right") - 1
    inside = maybe + index.q <= begins[text + 1]
    maybe, slot, text = maybe[inside], slot[inside], text[inside]
    many = index.starts[slot + 1] - index.starts[slot]
    posting = np.repeat(index.starts[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    return (
        np.repeat(text, many), np.repeat(maybe - begins[text], many), index.item[posting], index.place[posting], index.word[posting]
    )


def dense(group: np.ndarray, place: np.ndarray, word: np.ndarray, bound: np.ndarray, least: int) -> np.ndarray:
    """Whether at least ``bound`` different q-grams of the same group begin in the ``least`` words from an entry's word on."""
    order = np.lexsort((place, group))
    g, p, w = group[order], place[order], word[order]
    one = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])]) if len(g) else np.empty(0, bool)
    wide = int(word.max(initial=0)) + least + 1
    key = g[one] * wide + w[one]  # places go up with words, so this is sorted
    enough = np.searchsorted(key, key + least) - np.arange(len(key)) >= bound[order][one]
    out = np.empty(len(g), bool)
    out[order] = enough[np.cumsum(one) - 1]
    return out


def contains_passage(item: list[str], doc: list[str], least: int, one_in: int, open_end: bool = False) -> bool:
    """Whether some ``least`` or more consecutive words of ``item`` stand in ``doc`` with few enough edits.

    Edits are words altered, dropped or inserted, at most one in ``one_in`` of the item's words. A passage may begin
    with an edit, and end with one where ``open_end`` is set, else its last word must agree. Words written apart or
    together in one of the two are no edit. All beginnings in the item are aligned at once: row by item word, the best
    number of edits by (beginning, place in doc).
    """
    n, m = len(item), len(doc)
    if n < least or not m:
        return False
    line = f" {' '.join(doc)} "
    if any(f" {' '.join(item[j : j + least])} " in line for j in range(n - least + 1)):  # the plain case
        return True
    there = set(doc)
    near = there | {x + y for x, y in itertools.pairwise(doc)}
    known = [w in near for w in item]
    for j, (x, y) in enumerate(itertools.pairwise(item)):
        if x + y in there:
            known[j] = known[j + 1] = True
    if sum(known) < least - least // one_in:
        return False
    numbers = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([numbers[w] for w in item])
    d = np.array([numbers.get(w, -1) for w in doc])
    same = a[:, None] == d[None, :]
    split = np.array([numbers.get(x + y, -1) for x, y in itertools.pairwise(doc)], int)
    fuses = [x + y in there for x, y in itertools.pairwise(item)]
    wide, far = n - least + 1, n + m
    steps = np.arange(m + 1)
    before = np.full((wide, m + 1), far)
    older = None
    for j in range(n):
        if j < wide:
            before[j] = 0  # a passage may begin before any place in doc
        now = before + 1  # dropped
        now[:, 1:] = np.minimum(now[:, 1:], before[:, :-1] + ~same[j][None, :])
        ends = same[j].copy()
        if m > 1:
            apart = split == a[j]
            if apart.any():
                now[:, 2:] = np.where(apart[None, :], np.minimum(now[:, 2:], before[:, :-2]), now[:, 2:])
                ends[1:] |= apart
        if j and fuses[j - 1] and older is not None:
            together = np.array([w == item[j - 1] + item[j] for w in doc])
            now[:, 1:] = np.where(together[None, :], np.minimum(now[:, 1:], older[:, :-1]), now[:, 1:])
            ends |= together
        now = np.minimum.accumulate(now - steps, axis=1) + steps  # inserted
        if j + 1 < wide:
            now[j + 1 :] = far
        length = j + 1 - np.arange(wide)
        fits = (now[:, 1:] <= (length // one_in)[:, None]) & (ends | open_end)[None, :] & (length >= least)[:, None]
        if fits.any():
            return True
        older, before = before, now
    return False


_LETTER = np.array([c not in _DELETE for c in range(256)])


def word_starts(text: str) -> np.ndarray:
    """Where each word of a text begins in the squeezed text."""
    if text.isascii() and not ("&" in text or "<" in text or "\\" in text or "%" in text):
        letter = _LETTER[np.frombuffer(text.encode("ascii").translate(None, b"'`"), np.uint8)]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        return (np.cumsum(letter) - 1)[first]
    return np.concatenate([[0], np.cumsum([len(w.encode("utf-8", "replace")) for w in words(text)])])[:-1]


def _slice(short: bytes, starts: np.ndarray, low: int, high: int) -> list[str]:
    ends = [*starts[low + 1 : high + 1].tolist(), len(short)]
    return [short[a:b].decode() for a, b in zip(starts[low:high].tolist(), ends, strict=False)]


def verified(item: list[str], doc: list[str], bands: list[int], half: int, least: int, one_in: int) -> bool:
    """Whether the item stands in the document within one of the bands of diagonals (each two half-bands from a start)."""
    far = reach(least, one_in)
    for first in bands:
        low, high = max(0, first - far), max(0, first + 2 * half + len(item) + far)
        if contains_passage(item, doc[low:high], least, one_in, open_end=True):
            return True
    return False


def _matches(texts: list[tuple], index: ItemIndex, there: np.ndarray) -> Iterator[tuple]:
    """(item id, document id) of the passages of the index's items in texts (id, text, squeezed text)."""
    least, one_in, items = index.least, index.one_in, len(index.ids)
    hits = shared_grams(index, there, [s for _, _, s in texts])
    # Wherever they stand first, as that needs no words of the texts; then within bands of diagonals.
    pair = hits[0] * items + hits[2]
    if len(pair):
        _, back, many = np.unique(pair, return_inverse=True, return_counts=True)
        enough = many[back] >= index.bounds[hits[2]]
        hits = [h[enough] for h in hits]
    _, pair = np.unique(hits[0] * items + hits[2], return_inverse=True)
    good = dense(pair, hits[3], hits[4], index.bounds[hits[2]], least)
    keep = (np.bincount(pair, good) > 0)[pair] if len(pair) else good
    text, at, item, place, word = (h[keep] for h in hits)
    if not len(text):
        return
    begins = {t: word_starts(texts[t][1]) for t in np.unique(text).tolist()}
    doc_word = np.empty(len(text), np.int64)
    for t, starts in begins.items():
        mine = text == t
        doc_word[mine] = np.searchsorted(starts, at[mine], side="right") - 1
    half = spread(least, one_in)
    cell = (doc_word - word) // half
    twice = lambda x: np.concatenate([x, x])
    band = np.concatenate([cell, cell - 1])
    text, item, place, word, doc_word = map(twice, (text, item, place, word, doc_word))
    low = int(band.min())
    group = (text * items + item) * (int(band.max()) - low + 1) + band - low
    _, group = np.unique(group, return_inverse=True)
    good = dense(group, place, word, index.bounds[item], least)
    if not good.any():
        return
    order = np.argsort(group, kind="stable")
    wanted = np.unique(group[good])
    edges = (np.searchsorted(group[order], wanted, side=s) for s in ("left", "right"))
    far = reach(least, one_in)
    done: set = set()
    for a, b in zip(*edges, strict=True):
        mine = order[a:b]
        t, k = int(text[mine[0]]), int(item[mine[0]])
        if (t, k) in done:
            continue
        seeds = word[mine[good[mine]]]
        first, last = int(seeds.min()), int(seeds.max()) + least
        near = doc_word[mine[(word[mine] >= first) & (word[mine] < last)]]
        said = index.words[k][max(0, first - far) : last + far]
        doc = _slice(texts[t][2], begins[t], max(0, int(near.min()) - far), int(near.max()) + far + 1)
        if contains_passage(said, doc, least, one_in, open_end=True):
            done.add((t, k))
            yield index.ids[k], texts[t][0]


def _search(indexes: list[ItemIndex]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [i.filter_map() for i in indexes]
        for batch in batches:
            found: list[tuple] = []
            for texts in _blocks(batch):
                for index, there in zip(indexes, maps, strict=True):
                    found.extend(_matches(texts, index, there))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())],
                names=["item_id", "doc_id"],
            )

    return run


def _blocks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(id, text, squeezed text) of the texts that are not empty, in lists of some SCAN_BLOCK bytes."""
    waiting: list[tuple] = []
    size = 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            waiting.append((doc, text, squeezed(text)))
            size += len(waiting[-1][2])
        if size >= SCAN_BLOCK:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def leaked_items(documents: DataFrame, items: DataFrame, least: int = 14, one_in: int = 7, block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, doc_id): the documents that contain a passage of an item.

    ``documents`` has doc_id and text, ``items`` item_id and text; NULL and empty texts match nothing, items shorter
    than ``least`` words cannot be found, items without an id are left out, and an item that stands several times in a
    document, or rows written twice, give one row. Up to ``block`` items (counted first) are sent to all tasks as an index;
    every document is then read whole, once, and nothing is shuffled but the result. More items go through ``_joined``.
    """
    query = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    spark, schema = documents.sparkSession, "item_id bigint, doc_id bigint"
    rows = query.limit(block + 1).collect()
    if len(rows) > block:
        return _joined(documents.select("doc_id", "text"), query, least, one_in)
    indexes = build_indexes(sorted((r[0], r[1]) for r in rows), least, one_in)
    if not indexes:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(sent.value)(batches)

    return documents.select("doc_id", "text").mapInArrow(run, schema).distinct()


def _joined(documents: DataFrame, items: DataFrame, least: int, one_in: int) -> DataFrame:
    """``leaked_items`` for any number of items: their q-grams stay in a table.

    Documents give the q-grams that a map of bits (at most 2 ** _TABLE_BITS) knows from some item; they are joined on the
    q-gram, counted by document, item and band, and what reaches its bound is verified beside the two texts.
    """
    spark = documents.sparkSession

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("q", "gram", "item_id", "word", "bound", "text")}
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            text_of: dict = {}
            for i, t in pairs:
                text_of.setdefault(i, []).append(t)
            for i, texts in text_of.items():  # an id with several texts is several items
                for t in texts:
                    for q, kept in bounded([(i, t)], least, one_in):
                        for _, w, bound in kept:
                            codes, word = placed_grams(w, q)
                            for c, values in (("q", [q]), ("item_id", [i]), ("bound", [max(1, bound)]), ("text", [t])):
                                out[c] += values * len(codes)
                            out["gram"] += codes.view(np.int64).tolist()
                            out["word"] += word.tolist()
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    table = Written(items.mapInArrow(postings, "q int, gram bigint, item_id bigint, word int, bound int, text string"), "postings").read()
    size = table.count()
    if not size:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint")
    half = spread(least, one_in)
    bits = min(_TABLE_BITS, max(16, int(size * 8).bit_length()))
    sizes = sorted(r[0] for r in table.select("q").distinct().collect())

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["gram"].to_numpy(zero_copy_only=False).view(np.uint64)
            slot = np.unique((codes * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)
            word, back = np.unique(slot >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, back, np.uint64(1) << (slot & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    # At most 2 ** (_TABLE_BITS - 6) rows, each a word of the map.
    known = table.select("gram").mapInArrow(slots, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words_of = np.zeros(1 << (bits - 6), np.uint64)
    words_of[known["word"].to_numpy()] = known["mask"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(words_of)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = sent.value
        for batch in batches:
            for texts in _blocks(batch):
                for doc, text, short in texts:
                    begins = None
                    for q in sizes:
                        codes = gram_codes(short, q)
                        slot = (codes * _SPREAD) >> np.uint64(64 - bits)
                        at = np.flatnonzero((there[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                        if not len(at):
                            continue
                        begins = word_starts(text) if begins is None else begins
                        word = np.searchsorted(begins, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), q, np.int32)), pa.array(codes[at].view(np.int64)),
                                pa.array(np.full(len(at), doc, np.int64)), pa.array(word.astype(np.int32)),
                            ],
                            names=["q", "gram", "doc_id", "doc_word"],
                        )

    heard = documents.filter(F.col("doc_id").isNotNull()).mapInArrow(hits, "q int, gram bigint, doc_id bigint, doc_word int")
    cell = F.floor((F.col("doc_word") - F.col("word")) / F.lit(half))
    bands = (
        heard.join(table, ["q", "gram"])
        .groupBy("doc_id", "item_id", "text", "bound", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)))
        .groupBy("doc_id", "item_id", "text", "bound", "cell").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= F.col("bound"))
        .groupBy("doc_id", "item_id", F.col("text").alias("item_text")).agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                verified(words(i), words(d), [c * half for c in cells], half, least, one_in)
                for d, i, cells in zip(*(batch[c].to_pylist() for c in ("text", "item_text", "cells")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["item_id"], batch["doc_id"]], names=["item_id", "doc_id"]).filter(pa.array(good, pa.bool_()))

    texts = documents.select("doc_id", "text").filter(F.col("text") != "")
    found = bands.join(texts, "doc_id").select("item_id", "doc_id", "text", "item_text", "cells")
    return found.mapInArrow(check, "item_id bigint, doc_id bigint").distinct()


def leakage_report(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Which items leaked: (item_id, test_set, n_docs), every item with 0 where it was not found."""
    found = leaked_items(documents, items, **options).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "test_set").join(found, "item_id", "left").select(
        "item_id", "test_set", F.coalesce("n", F.lit(0)).alias("n_docs")
    )
