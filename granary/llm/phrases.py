"""Benchmark decontamination by a stored positional index of the training texts.

The index has a row for each text: its terms, how often each occurs, and the positions of all
occurrences, term after term, ascending. It is written once to the shared folder and serves every
block of the benchmark; rows of texts lie where the texts were read, so nothing is shuffled
and a lost executor only costs its part. To search, the rows of a few MB of texts make a shard's
postings for the benchmark's terms: a phrase's occurrences begin at the positions of its
rarest term, less its offset, intersected with the offset-adjusted lists of the other terms
from the rarest on; a proximity match is looked for around the occurrences of an item's rarest term.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import steps, steps_of, stored, table, texts_of

WINDOW = 10
#: An item is near a place if all its words lie in a span of so many times its words, and one.
SPAN = 2
#: Benchmark text that one broadcast block holds; a longer benchmark takes more blocks, one after the other.
BLOCK_BYTES = 8 << 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as UTF-8."""
    return text.translate(_WORDS).split()


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def spread(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices of ``counts`` entries from ``at`` on: the slice's number and the index of every entry."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(offsets(counts)[:-1], counts) + at[of]


class Phrases:
    """The windows of a block of items (``width`` consecutive words, or the whole of a shorter item) and the items' words, as arrays.

    A MB of benchmark text takes about ten times its size: ten term numbers of four bytes for
    each of its different windows, and the vocabulary.
    """

    def __init__(self, items: Iterable[tuple[str | None, bytes]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        streams, lengths, owner = [], [], []
        for item, text in items:
            words = words_of(text)
            if words:
                streams.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int32, len(words)))
                lengths.append(len(words))
                owner.append(-1 if item is None else names.setdefault(item, len(names)))
        #: items by number; rows of the same id are one item
        self.items = list(names)
        stream = np.concatenate([np.empty(0, np.int32), *streams])
        n_words, owners = np.array(lengths, np.int64), np.array(owner, np.int64)
        begin = offsets(n_words)[:-1]
        #: (windows as a matrix of terms, start and number of each one's items in ``flat``) by length
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        flat: list[np.ndarray] = [np.empty(0, np.int64)]
        size = 0
        for length in np.unique(np.minimum(n_words, width)).tolist():
            of, start = spread(begin, np.where(np.minimum(n_words, width) == length, n_words - length + 1, 0))
            first, which = self._distinct(stream, start, length)
            pairs = np.unique(which * (len(self.items) + 1) + owners[of] + 1)
            window, item = pairs // (len(self.items) + 1), pairs % (len(self.items) + 1) - 1
            named = item >= 0
            counts = np.bincount(window[named], minlength=len(first))
            self.groups.append((stream[start[first][:, None] + np.arange(length)], size + offsets(counts)[:-1], counts))
            flat.append(item[named])
            size += int(named.sum())
        self.flat = np.concatenate(flat)
        #: each named row's different terms, those rarest in the benchmark first, and the span they may take
        often = np.bincount(stream, minlength=len(self.vocabulary))
        row = np.repeat(np.arange(len(n_words)), n_words)
        pairs = np.unique(row * max(1, len(self.vocabulary)) + stream)
        row, term = pairs // max(1, len(self.vocabulary)), pairs % max(1, len(self.vocabulary))
        order = np.lexsort((term, often[term], row))
        order = order[owners[row[order]] >= 0]
        self.terms, counts = term[order], np.bincount(row[order], minlength=len(n_words))
        held = counts > 0
        self.near_at, self.near_n = (offsets(counts)[:-1])[held], counts[held]
        self.near_item, self.near_span = owners[held], SPAN * n_words[held]

    @staticmethod
    def _distinct(stream: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first of each different window, and each window's number among these."""
        key = np.zeros(len(start), np.uint64)
        for j in range(length):
            key = (key ^ stream[start + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        if all(np.array_equal(stream[start + j], stream[start[first[which]] + j]) for j in range(length)):
            return first, which
        # two windows share a hash: by the windows themselves
        _, first, which = np.unique(stream[start[:, None] + np.arange(length)], axis=0, return_index=True, return_inverse=True)
        return first, which.reshape(-1)


class Shard:
    """Postings of some texts for a benchmark's terms: positions by term, ascending, all texts in one row of positions."""

    def __init__(self, terms: np.ndarray, positions: np.ndarray, n_words: np.ndarray, n_terms: int):
        """``terms`` has the term of each position, -1 for none of the benchmark's; texts lie one position apart, so no phrase crosses."""
        self.begin, self.end = offsets(n_words + 1)[:-1], offsets(n_words + 1)[1:] - 1
        self.size = int((n_words + 1).sum())
        held = terms >= 0
        key = np.sort(terms[held] * self.size + positions[held])
        #: (term, position) pairs in order
        self.key, self.positions = key, key % max(1, self.size)
        self.first = np.searchsorted(key, np.arange(n_terms + 1) * self.size)
        self.counts = np.diff(self.first)

    def starts(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence of every window."""
        alive = np.arange(len(windows))
        for j in range(windows.shape[1]):
            alive = alive[self.counts[windows[alive, j]] > 0]
        windows = windows[alive].astype(np.int64)
        by_rarity = np.argsort(self.counts[windows], axis=1, kind="stable")
        rarest = windows[np.arange(len(alive)), by_rarity[:, 0]] if len(alive) else np.empty(0, np.int64)
        which, at = spread(self.first[rarest], self.counts[rarest])
        start = self.positions[at] - by_rarity[which, 0]
        keep = start >= 0
        which, start = which[keep], start[keep]
        for r in range(1, windows.shape[1]):
            if not len(which):
                break
            offset = by_rarity[which, r]
            keep = (start + offset < self.size) & self.holds(windows[which, offset], start + offset, start + offset)
            which, start = which[keep], start[keep]
        return alive[which], start

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a position between ``low`` and ``high``, both included."""
        at = np.searchsorted(self.key, term * self.size + low)
        inside = at < len(self.key)
        return inside & (self.key[np.where(inside, at, 0)] <= term * self.size + high) if len(self.key) else inside

    def text_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, positions, side="right") - 1

    def near(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(text, item number) of all proximity matches, in order.

        Around each occurrence of a row's rarest term, its other terms are looked for one after
        the other within the row's span and the text; the few that have all are swept.
        """
        if not len(phrases.near_at) or not len(self.key):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = self.counts[phrases.terms]
        least = np.minimum.reduceat(n, phrases.near_at)
        rows = np.flatnonzero(least > 0)
        # the rarest term of each row here
        is_least = np.flatnonzero(n == np.repeat(least, phrases.near_n))
        rarest = phrases.terms[is_least[np.searchsorted(is_least, phrases.near_at[rows])]]
        which, at = spread(self.first[rarest], self.counts[rarest])
        row, place = rows[which], self.positions[at]
        text = self.text_at(place)
        low, high = np.maximum(self.begin[text], place - phrases.near_span[row]), np.minimum(self.end[text] - 1, place + phrases.near_span[row])
        for r in range(int(phrases.near_n.max())):
            last = phrases.near_n[row] <= r
            keep = last | self.holds(phrases.terms[np.where(last, 0, phrases.near_at[row] + r)], low, high)
            row, text, low, high = row[keep], text[keep], low[keep], high[keep]
            if not len(row) or bool(last.all()):
                break
        pairs = np.unique(text * len(phrases.near_at) + row)
        found = [(t, phrases.near_item[x]) for t, x in zip((pairs // len(phrases.near_at)).tolist(), (pairs % len(phrases.near_at)).tolist(), strict=True) if self.swept(phrases, x, t)]
        found = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
        return found[:, 0], found[:, 1]

    def swept(self, phrases: Phrases, row: int, text: int) -> bool:
        """Whether one span holds all terms of a row: some occurrence of a term has all others in the span that ends there."""
        terms = phrases.terms[phrases.near_at[row] : phrases.near_at[row] + phrases.near_n[row]]
        ends = [self.positions[slice(*np.searchsorted(self.key, t * self.size + np.array([self.begin[text], self.end[text]])))] for t in terms]
        end = np.concatenate(ends)
        for t in terms:
            end = end[self.holds(np.full(len(end), t), np.maximum(self.begin[text], end - phrases.near_span[row]), end)]
        return len(end) > 0

    def hits(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Covered ranges (starts, ends; end exclusive) in all texts' positions, and (text, item number) of the items found, in order."""
        cover = np.zeros(self.size + 1, np.int64)
        pairs = [np.empty(0, np.int64)]
        for windows, owner_at, owner_n in phrases.groups:
            which, start = self.starts(windows)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + windows.shape[1], -1)
            seen = np.unique(self.text_at(start) * len(windows) + which)
            text, which = seen // len(windows), seen % len(windows)
            of, at = spread(owner_at[which], owner_n[which])
            pairs.append(text[of] * max(1, len(phrases.items)) + phrases.flat[at])
        edge = np.flatnonzero(np.diff(np.cumsum(cover[:-1]) > 0, prepend=False, append=False))
        pairs = np.unique(np.concatenate(pairs))
        return edge[0::2], edge[1::2], pairs // max(1, len(phrases.items)), pairs % max(1, len(phrases.items))


#: The index's own columns, beside those of the table that is indexed. Postings are packed, so that a text's are three values and
#: not three lists: terms with blanks between them, numbers of occurrences and positions as little-endian 32-bit integers.
INDEX = {"_n_words": "long", "_terms": "binary", "_counts": "binary", "_positions": "binary"}
PACKED = np.dtype("<i4")


def posted(texts: list[bytes]) -> list[pa.Array]:
    """The index's columns of some texts."""
    n_words, terms, counts, positions = [], [], [], []
    for text in texts:
        words = words_of(text)
        number = dict.fromkeys(words)
        number = dict(zip(number, range(len(number)), strict=True))
        ids = np.fromiter(map(number.__getitem__, words), PACKED, len(words))
        n_words.append(len(words))
        terms.append(b" ".join(number))
        counts.append(np.bincount(ids, minlength=len(number)).astype(PACKED).tobytes())
        positions.append(np.argsort(ids, kind="stable").astype(PACKED).tobytes())
    return [pa.array(n_words, pa.int64()), *(pa.array(x, pa.binary()) for x in (terms, counts, positions))]


def index(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The positional index of the whole texts: a stored table of the columns ``keep`` and, for each row, the postings of its text (INDEX)."""
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]), *(f"{k} {v}" for k, v in INDEX.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(len(keep)))
            for a, b in steps(texts):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *posted(texts[a:b])], [*keep, *INDEX])

    return stored(rows.mapInArrow(run, schema), "postings")


def shards(batch: pa.RecordBatch, at: int, phrases: Phrases) -> Iterator[tuple[int, int, Shard]]:
    """Ranges of a batch's rows (of a few MB, or one) with their shard; the index's columns begin at column ``at``."""
    sizes = batch.column(at).to_numpy()
    terms, counts, positions = (c.to_pylist() for c in batch.columns[at + 1 : at + 4])
    for a, b in steps_of([6 * n for n in sizes.tolist()]):
        own = b" ".join(terms[a:b]).split()
        ids = np.fromiter(map(phrases.vocabulary.get, own, repeat(-1)), np.int64, len(own))
        often, place = (np.frombuffer(b"".join(x[a:b]), PACKED).astype(np.int64) for x in (counts, positions))
        words = sizes[a:b]
        place += np.repeat(offsets(words + 1)[:-1], words)
        yield a, b, Shard(np.repeat(ids, often), place, words, len(phrases.vocabulary))


def blocks(items: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark as (item_id as string, text) in blocks of at most ``BLOCK_BYTES`` of text, or one item."""
    block, size = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator():
        data = text.encode()
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, data))
        size += len(data)
    yield block


_loaded: dict[str, Phrases] = {}


def _phrases(shared, width: int) -> Phrases:
    """One for each Python worker and block."""
    name, block = shared.value
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Phrases(block, width)
    return _loaded[name]


def find_phrases(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, the word ranges hit (starts, ends; end exclusive), the items found there, and the items near, of every whole text.

    Items are windows of ``width`` words; an item of fewer words, but not none, is one window.
    An item is near if all its words (each once, in any order) lie in one span of the text
    whose last word is at most SPAN times the item's words behind its first one; that
    depends on item and text alone. One row for each row of ``docs``. Null and empty texts, and items
    without words, have none. Occurrences of an item whose id is null are hit, but name no
    item; items of the same id are one (near if any of its rows is). Repeated rows stay; other
    columns are ignored; empty tables give no rows or no hits.
    """
    sc = docs.sparkSession.sparkContext
    lists = {"starts": "array<long>", "ends": "array<long>", "items": "array<string>", "near": "array<string>"}
    schema = ", ".join(["doc_id long", *(f"{k} {v}" for k, v in (INDEX | lists).items())])
    postings = index(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    out = postings.select("*", *(F.array().cast(v).alias(k) for k, v in lists.items()))
    for block in blocks(items):
        shared = sc.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = _phrases(shared, width)
            for batch in batches:
                starts, ends, found, near = (c.to_pylist() for c in batch.columns[5:])
                for a, _, shard in shards(batch, 1, phrases):
                    low, high, text, item = shard.hits(phrases)
                    of = shard.text_at(low)
                    for t in np.unique(of).tolist():
                        own = of == t
                        starts[a + t], ends[a + t] = merged(starts[a + t] + (low[own] - shard.begin[t]).tolist(), ends[a + t] + (high[own] - shard.begin[t]).tolist())
                    for t, x in zip(text.tolist(), item.tolist(), strict=True):
                        found[a + t].append(phrases.items[x])
                    for t, x in zip(*(y.tolist() for y in shard.near(phrases)), strict=True):
                        near[a + t].append(phrases.items[x])
                made = [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), *(pa.array([sorted(set(x)) for x in y], pa.list_(pa.string())) for y in (found, near))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], ["doc_id", *INDEX, *lists])

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), *lists)


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Ranges put in order, those that meet made one."""
    a, b = [], []
    for start, end in sorted(zip(starts, ends, strict=True)):
        if b and start <= b[-1]:
            b[-1] = max(b[-1], end)
        else:
            a.append(start)
            b.append(end)
    return a, b


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of any item occurs; null texts stay. The rows are kept with their postings while the benchmark is searched."""
    names = docs.columns
    postings = index(docs, names)
    out = postings
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = _phrases(shared, width)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, shard in shards(batch, len(names), phrases):
                    clean[a + np.unique(shard.text_at(shard.hits(phrases)[0]))] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, postings.schema)
    return out.select(*names)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
        F.sha2(F.array_join("near", ","), 256).alias("near_sha256"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r),
it AS (SELECT row_number() OVER () AS k, item_id, {SPAN} * len(w) AS span, len(list_distinct(w)) AS n_terms, list_distinct(w) AS terms FROM i WHERE len(w) > 0 AND item_id IS NOT NULL),
term AS (SELECT k, unnest(terms) AS t FROM it),
doc_term AS (SELECT r, unnest(list_distinct(w)) AS t FROM d),
whole AS (SELECT r, k FROM doc_term JOIN term USING (t) JOIN it USING (k) GROUP BY r, k, n_terms HAVING count(*) = n_terms),
place AS (SELECT r, w[p] AS t, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE r IN (SELECT r FROM whole))),
held AS (SELECT r, k, t, p, span, n_terms, lead(p) OVER (PARTITION BY r, k, t ORDER BY p) AS later FROM whole JOIN it USING (k) JOIN term USING (k) JOIN place USING (r, t)),
near_at AS (
  SELECT a.r, a.k FROM held a JOIN held b ON a.r = b.r AND a.k = b.k AND b.p BETWEEN a.p - a.span AND a.p AND (b.later IS NULL OR b.later > a.p)
  GROUP BY a.r, a.k, a.p, a.n_terms HAVING count(*) = a.n_terms),
near AS (
  SELECT r, count(*) AS n_near, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM near_at JOIN it USING (k)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(found.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near.s, '')) AS near_sha256
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r) LEFT JOIN near USING (r)
"""
