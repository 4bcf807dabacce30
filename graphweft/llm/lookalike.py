"""One consistent form for texts that look the same but are written in different characters.

The form folds width forms, joined and separate accents, characters that show nothing, kinds of blanks, and look-alike
letters of other scripts and symbol blocks. It keeps what can be seen: case, accents, raised digits, punctuation, numbers
of blanks. A batch of texts is handled as one array of code points: a table gather gives each code point's replacement,
expansion offsets place replacements of other lengths, marks are ordered and composed by array operations. There are no
calls per row.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like a Latin letter, script by script.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ӏ": "l", "һ": "h",
    "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j",
    # Armenian, Latin extensions
    "Օ": "O", "օ": "o", "Տ": "S", "Ս": "U", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M",
    "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E",
    "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲏ": "H", "Ⲙ": "M", "Ⲛ": "N", "Ⲭ": "X",
    # kana that are drawn alike
    "へ": "ヘ",
}
#: Format characters that do show something, and further ones that show nothing (first and last of a range).
VISIBLE_FORMATS = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))
INVISIBLE = ((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Compatibility forms that look like what they stand for; raised, lowered, circled and squared ones don't.
_FOLDED_TAGS = frozenset(("<wide>", "<narrow>", "<font>", "<noBreak>"))
_COMPAT_RANGES = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3))
_DROP, _KEEP_BLANKS = -1, frozenset("\t\n\r\x0b\x0c\x85")
#: Code points handled at once; bounds a task's memory, texts are never cut.
CHUNK = 2_000_000


def _inside(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _unfold(ch: str) -> str:
    """What one character becomes, before look-alikes and blanks."""
    cp = ord(ch)
    parts = unicodedata.decomposition(ch).split()
    if 0xAC00 <= cp <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    if not parts:
        return ch
    if parts[0].startswith("<"):
        if parts[0] not in _FOLDED_TAGS and not (parts[0] == "<compat>" and _inside(cp, _COMPAT_RANGES)):
            return ch
        parts = parts[1:]
    return "".join(_unfold(chr(int(p, 16))) for p in parts)


def _shown(ch: str) -> str:
    cp, kind = ord(ch), unicodedata.category(ch)
    if ch in _KEEP_BLANKS:
        return ch
    if (kind == "Cf" and not _inside(cp, VISIBLE_FORMATS)) or _inside(cp, INVISIBLE):
        return ""
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    return LOOKALIKES.get(ch, ch)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(replacement by code point: one, -1 none, or -2 - k for expansion k; expansions' starts; their code points; combining
    class by code point; sorted pairs that compose; what they compose to). Built by rule, once in a worker."""
    n = 0x110000
    one = np.arange(n, dtype=np.int32)
    classes = np.zeros(n, dtype=np.uint8)
    starts, flat, pairs = [0], [], {}
    for cp in itertools.chain(range(0xD800), range(0xE000, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000)):  # the rest is ideographs, private or unassigned
        ch = chr(cp)
        classes[cp] = unicodedata.combining(ch)
        if cp < 0x20 or cp >= 0x7F:
            to = "".join(_shown(x) for x in _unfold(ch))
            if len(to) == 1:
                one[cp] = ord(to)
            elif not to:
                one[cp] = _DROP
            else:
                one[cp] = -2 - (len(starts) - 1)
                flat += map(ord, to)
                starts.append(len(flat))
        if 0xAC00 <= cp <= 0xD7A3:
            tail = (cp - 0xAC00) % 28
            a, b = (chr(cp - tail), chr(0x11A7 + tail)) if tail else unicodedata.normalize("NFD", ch)
            pairs[ord(a) << 21 | ord(b)] = cp
        else:
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
                a, b = (_shown(chr(int(p, 16))) for p in parts)
                key = ord(a) << 21 | ord(b)
                if key not in pairs or cp < pairs[key]:  # of look-alikes with the same parts, the first
                    pairs[key] = cp
    keys = np.array(sorted(pairs), dtype=np.int64)
    return one, np.array(starts, dtype=np.int64), np.array(flat, dtype=np.int32), classes, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int32)


def _ordered(cp: np.ndarray, row_start: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks of each run in canonical order."""
    c = classes[cp]
    wrong = (c[1:] > 0) & (c[:-1] > c[1:]) & ~row_start[1:]
    if not wrong.any():
        return cp
    marks = np.flatnonzero(c > 0)
    fresh = np.r_[True, (np.diff(marks) > 1) | row_start[marks[1:]]]
    order = np.lexsort((c[marks], np.cumsum(fresh)))
    cp = cp.copy()
    cp[marks] = cp[marks[order]]
    return cp


def fold_code_points(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts laid end to end (text i is offsets[i]:offsets[i + 1]) in the consistent form."""
    one, starts, flat, classes, keys, composed = tables()
    to = one[cp]
    odd = np.flatnonzero(to < 0)
    if len(odd):
        size = np.ones(len(to), dtype=np.int32)
        k = -2 - to[odd]
        grown = k >= 0
        size[odd] = np.where(grown, starts[np.maximum(k, 0) + 1] - starts[np.maximum(k, 0)], 0)
        place = np.zeros(len(to) + 1, dtype=np.int64)
        np.cumsum(size, out=place[1:])
        out = np.repeat(to, size)
        at, k = odd[grown], k[grown]
        length = size[at].astype(np.int64)
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(place[at], length) + inner] = flat[np.repeat(starts[k], length) + inner]
        to, offsets = out, place[offsets]
    row_start = np.zeros(len(to) + 1, dtype=bool)
    row_start[offsets[:-1]] = True
    row_start = row_start[:-1]
    if len(to) > 1 and (to > 0x2FF).any():
        to = _ordered(to, row_start, classes)
        first_mark = 0x300  # nothing below this is the second of a pair
        while True:
            maybe = np.flatnonzero((to[1:] >= first_mark) & ~row_start[1:])
            if not len(maybe):
                break
            pair = to[maybe].astype(np.int64) << 21 | to[maybe + 1].astype(np.int64)
            found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = keys[found] == pair
            maybe, found = maybe[hit], found[hit]
            if not len(maybe):
                break
            lead = np.r_[True, np.diff(maybe) > 1]  # the first of overlapping pairs; the rest wait for the next round
            maybe, found = maybe[lead], found[lead]
            to = to.copy()
            to[maybe] = composed[found]
            keep = np.ones(len(to), dtype=bool)
            keep[maybe + 1] = False
            place = np.zeros(len(to) + 1, dtype=np.int64)
            np.cumsum(keep, out=place[1:])
            to, row_start, offsets = to[keep], row_start[keep], place[offsets]
    return to, offsets


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets as code points and their offsets."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    if len(cp) == len(data):
        return cp, offsets
    place = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=place[1:])
    return cp, place[offsets]


def fold_texts(texts: pa.Array) -> pa.Array:
    """A string array in the consistent form; nulls stay null, empty texts empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    nulls = np.asarray(texts.is_null())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    done, sizes, i = [], [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        cp, offsets = fold_code_points(*_code_points(data[at[i] : at[j]], at[i : j + 1] - at[i]))
        width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        place = np.zeros(len(cp) + 1, dtype=np.int64)
        np.cumsum(width, out=place[1:])
        done.append(cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"))
        sizes.append(np.diff(place[offsets]))
        i = j
    out = np.zeros(n + 1, dtype=np.int64)
    if sizes:
        np.cumsum(np.concatenate(sizes), out=out[1:])
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(out.tobytes()), pa.py_buffer(b"".join(done)), valid)


def fold_column(df: DataFrame, text: str = "text", out: str = "folded") -> DataFrame:
    """``df`` with ``out``, the consistent form of ``text``. Null stays null, empty stays empty; every other column passes
    unchanged, and a column already named ``out`` is replaced."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).withColumn(out, F.lit(None).cast("string")).schema
    at = kept.index(text)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = fold_texts(b.column(at))
            if folded.nbytes < 2**31 - 1:
                folded = folded.cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, folded], names=[*kept, out])

    return df.select(*kept).mapInArrow(fold, schema)


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, look (16-byte digest of the consistent form), writing (that of the text itself), for texts that aren't empty."""
    have = documents.where(F.length(text) > 0).select(key, text)
    return fold_column(have, text, "folded").select(key, F.unhex(F.md5("folded")).alias("look"), F.unhex(F.md5(text)).alias("writing"))


def look_members(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the least key of the texts of that look), documents, writings: one row per document with text, with how
    many documents and how many different writings its class has. Classes of any size: nothing is paired."""
    docs = look_classes(documents, key, text)
    by_writing = docs.groupBy("look", "writing").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    classes = by_writing.groupBy("look").agg(F.min("least").alias("class_id"), F.sum("n").alias("documents"), F.count("*").alias("writings"))
    return docs.join(classes, "look").select(key, "class_id", "documents", "writings")


def same_look_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_1 < doc_id_2): texts of the same look written in different characters, once per look; rows repeated count once.

    Identical, null and empty texts make no pair. Only looks with more than one writing are joined; adaptive skew handling
    splits what remains. The pairs are what is asked for: a look with n documents in one writing and m in another has n m of
    them, and :func:`look_members` says the same in one row per document."""
    docs = look_classes(documents, key, text)
    writings = docs.groupBy("look").agg(F.min("writing").alias("lo"), F.max("writing").alias("hi")).where("lo <> hi").select("look")
    # once per look and document before they meet, so that pairs come once
    mixed = docs.join(writings, "look", "left_semi").groupBy("look", key).agg(F.min("writing").alias("lo"), F.max("writing").alias("hi"))
    a, b = (mixed.select("look", F.col(key).alias(f"doc_id_{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")) for i in (1, 2))
    other = (F.col("lo1") != F.col("lo2")) | (F.col("hi1") != F.col("hi2")) | (F.col("lo1") != F.col("hi1"))
    return a.join(b, "look").where((F.col("doc_id_1") < F.col("doc_id_2")) & other).select("doc_id_1", "doc_id_2")
