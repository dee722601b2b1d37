"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over a text's words measure how many characters lie inside n-grams
that the text has had before, and inside lines that it has had before. Texts over a limit are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, code_points, documents, encode, lean, mixed, text_column, within

#: Largest share of a text's word characters inside repeated n-grams, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of characters, in repeated lines.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
MIN_WORDS = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, dup_chars array<long>"


def _cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of that width beginning at one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def _repeats(codes: np.ndarray) -> np.ndarray:
    """Marks values that were there before."""
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    out = np.zeros(len(codes), dtype=bool)
    out[order[1:][same]] = True
    return out


def measure(texts: pa.Array, limits: dict[int, float] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """The measures of each text. Words and their windows are compared exactly for the base columns."""
    w = Words(texts)
    points = code_points(w.raw)
    word_chars = within(points & w.is_word, w.bounds)
    out = {"n_words": w.counts, "word_chars": word_chars, "n_symbols": within(_SYMBOL[w.raw], w.bounds)}

    ids, words = w.ids()
    n = len(ids)
    repeat = np.zeros(n, dtype=bool)
    if n >= 3:
        inside = w.doc[2:] == w.doc[:-2]
        pair, pairs = encode(ids[:-1] * max(len(words), 1) + ids[1:])
        triple, triples = encode(pair[:-1] * max(len(words), 1) + ids[2:])
        own, kinds = encode((triple * w.n_docs + w.doc[:-2])[inside])
        often = np.bincount(own, minlength=kinds)[own] > 1
        repeat = _cover(np.flatnonzero(inside)[often], 3, n)
    out["n_repeat_words"] = within(repeat, w.first)

    total = np.zeros(len(points) + 1, np.int64)
    np.cumsum(points, out=total[1:])
    chars = total[w.ends] - total[w.starts]
    code = mixed(ids.astype(np.uint64))
    salt = mixed(w.doc.astype(np.uint64) + np.uint64(1 << 40))
    dup_chars = []
    rolled = code
    with np.errstate(over="ignore"):
        for k in range(2, max(limits) + 1):
            rolled = rolled[:-1] * _BASE + code[k - 1 :] if n >= k else rolled[:0]
            if k not in limits:
                continue
            if len(rolled):
                inside = np.flatnonzero(w.doc[k - 1 :] == w.doc[: n - k + 1])
                again = inside[_repeats(mixed(rolled[inside]) ^ salt[inside])]
                covered = _cover(again, k, n)
            else:
                covered = np.zeros(n, dtype=bool)
            dup_chars.append(within(np.where(covered, chars, 0), w.first))
    out["dup_chars"] = np.stack(dup_chars, axis=1)

    # lines: cut after each \n and at each text's end
    breaks = np.flatnonzero(w.raw == 0x0A)
    doc_of = np.searchsorted(w.bounds, breaks, side="right") - 1
    cuts = np.concatenate([breaks, w.bounds[1:]])
    owner = np.concatenate([doc_of, np.arange(w.n_docs)])
    order = np.lexsort((np.concatenate([np.zeros(len(doc_of), np.int8), np.ones(w.n_docs, np.int8)]), cuts, owner))
    cuts, owner = cuts[order], owner[order]
    begin = np.empty_like(cuts)
    if len(cuts):
        begin[0] = w.bounds[0]
        begin[1:] = np.where(owner[1:] == owner[:-1], cuts[:-1] + 1, w.bounds[owner[1:]])
    seen = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(w.is_word, out=seen[1:])
    full = seen[cuts] > seen[begin]
    begin, cuts, owner = begin[full], cuts[full], owner[full]
    lines = pa.array([w.raw[a:b].tobytes() for a, b in zip(begin.tolist(), cuts.tolist())], pa.binary())
    line_id, kinds = encode_array(lines)
    again = _repeats(owner * max(kinds, 1) + line_id)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=w.n_docs)
    out["n_lines"] = np.bincount(owner, minlength=w.n_docs)
    word_points = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(points & w.is_word, out=word_points[1:])
    line_chars = word_points[cuts] - word_points[begin]
    out["dup_line_chars"] = np.bincount(owner[again], weights=line_chars[again], minlength=w.n_docs).astype(np.int64)

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    bad = (out["n_dup_lines"] > LINE_LIMIT * out["n_lines"]) | (out["dup_line_chars"] > LINE_CHARS_LIMIT * word_chars)
    for i, (_, most) in enumerate(sorted(limits.items())):
        bad |= out["dup_chars"][:, i] > most * word_chars
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def encode_array(values: pa.Array) -> tuple[np.ndarray, int]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, the measures and the verdict.

    Null text counts as empty, has no words and is not kept; repeated rows each give a row; an empty table gives
    an empty one; other columns are left aside, so their names cannot clash. Narrow: no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                m = measure(part.column(1))
                cover = pa.ListArray.from_arrays(np.arange(len(m["kept"]) + 1, dtype=np.int32) * m["dup_chars"].shape[1], pa.array(m["dup_chars"].ravel()))
                longs = [pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *longs, pa.array(m["base_failed"]), pa.array(m["kept"]), pa.array(m["dup_line_chars"]), cover],
                    names=["k", *[f.split()[0] for f in SCHEMA.split(", ")]],
                )

    got = docs.select(F.col(key).alias("k"), text_column(docs, text).alias("t")).mapInArrow(lean(run), f"k {kind}, {SCHEMA}")
    return got.withColumnRenamed("k", key)


def op2_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars")
