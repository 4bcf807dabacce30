"""Encoding of a corpus by a public byte-level BPE, as relational fixpoints in DuckDB inside each partition.

Texts are split into words by the tokenizer's own pattern, computed on arrays of code points. The distinct new words of a
batch become token-position rows (word, position, id), one row a byte. A recursive query joins neighbouring rows with the
merge table and contracts each word's leftmost pair of minimum rank, until no pair of any word can merge; it keeps the
latest row of each (word, position) only, and words that are done leave the recursion. Ordered aggregation turns rows back
into ids, per word and then per document. Words seen before in a worker are not merged again. Nothing is shuffled: a batch
is encoded where it is read.

A word is seen through windows that overlap by half, most words through one. Each window is encoded by the same query, and
neighbours are joined at a token that both have at the same place. That is exact: a sequence of tokens is the encoding of
its bytes as soon as every two neighbours are that of theirs, and all neighbours of the joined sequence stand side by side in
some window. A word with two windows that share no token is seen through windows four times as wide, in the end as a whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphweft.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of texts split at once, of windows looked up at once, of new windows merged at once, and of words a worker keeps with
#: their ids; they bound memory, texts are never cut.
BATCH_BYTES, LOOKUP_BYTES, MERGE_BYTES, KEPT_BYTES = 3_000_000, 4_000_000, 1_000_000, 120_000_000
#: Bytes of the first windows of a word. Half of it is a multiple of 16 and of 3, the sizes that tokens of repeated
#: characters have, so that windows on long repetitions share tokens.
WINDOW = 96
#: Fixed values of the tokenizer's pattern: what may follow an apostrophe as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3


_KINDS = np.full(0x110000, 255, dtype=np.uint8)  # filled in by blocks of code points, when first met


def _kinds_of(cp: np.ndarray) -> np.ndarray:
    """The kind of every code point in the Unicode version of the tokenizer library, asked of its own patterns."""
    from tokenizers import Regex, pre_tokenizers

    kinds = _KINDS[cp]
    if len(kinds) and kinds.max() == 255:
        blocks = np.unique(cp[kinds == 255] >> 12).astype(np.int64)
        points = (blocks[:, None] * 4096 + np.arange(4096)).ravel()
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        _KINDS[points] = _OTHER
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            hit = np.ones(len(points), dtype=bool)
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), behavior="removed").pre_tokenize_str(text):
                hit[a:b] = False
            _KINDS[points[hit]] = kind
        kinds = _KINDS[cp]
    return kinds


def word_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words start in code points of texts laid end to end. The pattern: contractions; runs of letters, of numbers or
    of other characters, each with a space before it; blanks, of which the last stays with what follows."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _kinds_of(cp)
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts[text_starts < n]] = True
    first = first[:n]
    blank, space = kind == _BLANK, cp == 0x20
    change = np.r_[True, kind[1:] != kind[:-1]] | first
    start = change.copy()
    # the last blank of a run, if something follows, is parted from the blanks before it; a space then joins what follows
    followed = np.r_[blank[:-1] & ~blank[1:] & ~first[1:], False]
    start |= followed
    joined = np.flatnonzero(followed & space) + 1
    start[joined] = False
    # contractions: an apostrophe alone at the start of a word, and what follows it
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        at = lambda k: np.where((quote + k < n), cp[np.minimum(quote + k, n - 1)], 0)
        # a second letter belongs to the same text only if no text starts there
        same = np.where(quote + 2 < n, ~first[np.minimum(quote + 2, n - 1)], False)
        size = np.zeros(len(quote), dtype=np.int64)
        for c in CONTRACTIONS:
            hit = at(1) == ord(c[0])
            if len(c) == 2:
                hit &= same & (at(2) == ord(c[1]))
            size = np.where((size == 0) & hit, len(c), size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        start[after[inside]] = True
    return np.flatnonzero(start)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one string array on the texts' own bytes, and each word's text number."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte place of each code point
    starts = word_starts(cp, np.searchsorted(lead, at[:-1]))
    places = np.append(lead[starts], len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.tobytes()), pa.py_buffer(data.tobytes()))
    return words, np.searchsorted(at, places[:-1], side="right") - 1


def byte_letters() -> dict[int, str]:
    """The tokenizer's letter for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_PLACE = (1 << 40) - 1

#: start: w, pos, id, next_id. A swallowed row keeps its place with a null id.
_MERGE = f"""
INSERT INTO known
WITH RECURSIVE tok(w, pos, id, next, next_id) USING KEY (w, pos) AS (
    SELECT w, pos, id, CASE WHEN next_id IS NOT NULL THEN pos + 1 END, next_id FROM start
  UNION ALL
    SELECT t.w, t.pos, CASE WHEN t.pos = c.gone THEN NULL WHEN t.pos = c.pos THEN c.made ELSE t.id END, CASE WHEN t.pos = c.pos THEN c.after ELSE t.next END,
        CASE WHEN t.pos = c.pos THEN c.after_id WHEN t.next = c.pos THEN c.made ELSE t.next_id END
    FROM tok t JOIN (
        SELECT b.w, b.first & {_PLACE} AS pos, b.gone, b.made, x.next AS after, x.next_id AS after_id
        FROM (
            SELECT p.w, min(m.rank << 40 | p.pos) AS first, arg_min(p.next, m.rank << 40 | p.pos) AS gone, arg_min(m.made, m.rank << 40 | p.pos) AS made
            FROM tok p JOIN merges m ON m.pair = p.id::BIGINT << 20 | p.next_id GROUP BY p.w) b
        JOIN tok x ON x.w = b.w AND x.pos = b.gone) c ON t.w = c.w
    WHERE t.id IS NOT NULL
)
SELECT any_value(n.word), list(t.id ORDER BY t.pos) FROM tok t JOIN new_words n ON n.w = t.w WHERE t.id IS NOT NULL GROUP BY t.w
"""


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte strings data[start : start + size], which may overlap, as one binary array."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())])


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that hold ``most`` bytes together, or one alone."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


class RelationalBPE:
    """A DuckDB database with a merge table and the words known so far."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = pa.table({"pair": pa.array([ids[a] << 20 | ids[b] for a, b in pairs], pa.int64()), "rank": pa.array(range(len(pairs)), pa.int64()), "made": pa.array([ids[a + b] for a, b in pairs], pa.int32())})
        letters = byte_letters()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.byte_ids[list(letters)] = [ids[x] for x in letters.values()]
        self.sizes = np.zeros(max(ids.values()) + 1, dtype=np.int64)  # of the tokens that bytes can make, a letter a byte
        self.sizes[list(ids.values())] = [len(x) for x in ids]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS FROM merges_in; CREATE TABLE known(word BLOB, ids INTEGER[])")
        self.kept = 0

    def _learn(self, words: pa.Array) -> None:
        """Merges new words into ``known``."""
        at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        ids = self.byte_ids[np.frombuffer(words.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]]
        size = np.diff(at)
        pos = np.arange(len(ids)) - np.repeat(at[:-1] - at[0], size)
        following = pa.array(np.append(ids[1:], 0), pa.int32(), mask=pos == np.repeat(size, size) - 1)
        self.db.register("start", pa.table({"w": pa.array(np.repeat(np.arange(len(words)), size), pa.int32()), "pos": pa.array(pos, pa.int64()), "id": pa.array(ids, pa.int32()), "next_id": following}))
        self.db.register("new_words", pa.table({"word": words, "w": pa.array(np.arange(len(words)), pa.int32())}))
        self.db.execute(_MERGE)
        self.kept += len(ids) * 5 + len(words) * 64

    def _lookup(self, words: pa.Array) -> pa.Array:
        """The ids of each word, in order."""
        if self.kept > KEPT_BYTES:
            self.db.execute("TRUNCATE known")
            self.kept = 0
        self.db.register("asked", pa.table({"word": words, "n": pa.array(np.arange(len(words)), pa.int32())}))
        new = self.db.sql("SELECT DISTINCT word FROM asked ANTI JOIN known USING (word)").to_arrow_table()["word"].combine_chunks().cast(pa.large_binary())
        for i, j in _blocks(pa.compute.binary_length(new).to_numpy(), MERGE_BYTES):
            self._learn(new.slice(i, j - i))
        return self.db.sql("SELECT k.ids FROM asked JOIN known k USING (word) ORDER BY n").to_arrow_table()["ids"].combine_chunks()

    def _through_windows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, word number of each, whether the word's windows could be joined), words one after the other."""
        stride = window // 2
        count = 1 + np.maximum(0, -(-(sizes - window) // stride))
        word = np.repeat(np.arange(len(sizes)), count)
        first = np.cumsum(count) - count
        shift = (np.arange(len(word)) - first[word]) * stride
        size = np.minimum(window, sizes[word] - shift)
        got = [self._lookup(_pieces(data, starts[word[i:j]] + shift[i:j], size[i:j])) for i, j in _blocks(size, LOOKUP_BYTES)]
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *[g.flatten().to_numpy() for g in got]])
        lengths = np.concatenate([np.zeros(0, dtype=np.int64), *[pa.compute.list_value_length(g).to_numpy() for g in got]]).astype(np.int64)
        joined = np.ones(len(sizes), dtype=bool)
        if len(word) == len(sizes):
            return ids, np.repeat(word, lengths), joined
        w = np.repeat(np.arange(len(word)), lengths)  # window of each token, and its place in the word
        upto = np.cumsum(self.sizes[ids])
        place = upto - self.sizes[ids] - np.repeat(np.append(0, upto)[np.cumsum(lengths) - lengths], lengths) + shift[w]
        # the second half of a window is the first of the next: a token is known by half, place and size
        more = np.append(word[1:] == word[:-1], False)  # windows with a next one
        end = place + self.sizes[ids]
        left = np.flatnonzero(more[w] & (place >= shift[w] + stride))
        right = np.flatnonzero((shift[w] > 0) & (end <= shift[w] + stride))
        span = (place - shift[w]) % stride * (2 * window) + self.sizes[ids]
        wide = np.int64(stride) * 2 * window + 2 * window
        shared = np.intersect1d(w[left] * wide + span[left], (w[right] - 1) * wide + span[right])
        owner = shared // wide
        meets, at = np.unique(owner, return_index=True)
        cut = np.zeros(len(word), dtype=np.int64)  # where a window's next one takes over
        cut[~more] = np.iinfo(np.int64).max
        cut[meets] = shift[meets] + stride + (shared[at] % wide) // (2 * window)
        lost = more.copy()
        lost[meets] = False
        joined[word[lost]] = False
        begin = np.where(shift > 0, np.append(0, cut[:-1]), 0)
        keep = (place >= begin[w]) & (place < cut[w]) & joined[word[w]]
        return ids[keep], word[w[keep]], joined

    def encode(self, texts: pa.Array) -> pa.Array:
        """ids of each text as list<int32>; a text without words (empty or null) has an empty list."""
        words, text_no = words_of(texts.fill_null(""))
        at = np.frombuffer(words.buffers()[1], dtype=np.int64)
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        sizes = np.diff(at)
        left, window, parts = np.arange(len(sizes)), WINDOW, []
        while len(left):
            ids, of, joined = self._through_windows(data, at[:-1][left], sizes[left], window)
            parts.append((ids, left[of]))
            left, window = left[~joined], window * 4
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *[p[0] for p in parts]])
        of = np.concatenate([np.zeros(0, dtype=np.int64), *[p[1] for p in parts]])
        if len(parts) > 1:
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        ends = np.append(0, np.cumsum(np.bincount(text_no[of], minlength=len(texts)) if len(texts) else []))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


@functools.cache
def _worker(vocabulary: str) -> RelationalBPE:
    return RelationalBPE(vocabulary)


def encode_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and ``ids``, the text's token ids without special tokens. Empty and null texts have no tokens: an empty list.
    Strings of special tokens in a text are ordinary text. ``vocabulary`` is a path that every executor can read."""
    kept = spread(documents.select(key, text))
    kind = kept.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(vocabulary)
        for b in batches:
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, j in _blocks(size, BATCH_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), bpe.encode(part.column(1))], names=[key, "ids"])

    return kept.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
