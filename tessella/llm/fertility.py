"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback splits each whole text. Three measures follow: code points per token, the share
of byte-fallback tokens and the entropy of the text's token distribution in bits. Each script has a band for each
measure, the entropy's relative to the length; a text outside a band of its dominant script is rejected. Besides, plain base rules count words and repeats.

Defined results: null and empty text has no words and fails the base rules; texts of any length are measured whole;
repeated rows are measured alike; an empty table gives an empty result; other columns are left alone or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import byte_view, clash_free, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Scripts, and the first UTF-8 bytes (ranges, inclusive) that stand for each.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
LEAD_BYTES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCB)), "greek": ((0xCE, 0xCF),), "cyrillic": ((0xD0, 0xD4),), "hebrew": ((0xD6, 0xD7),),
    "arabic": ((0xD8, 0xDD),), "indic": ((0xE0, 0xE0),), "kana": ((0xE3, 0xE3),), "han": ((0xE4, 0xE9),), "hangul": ((0xEA, 0xED),), "other": ((0xE1, 0xE1), (0xF0, 0xF4)),
}
#: Rejection bands per script: least and most code points a token, most byte-fallback share, least entropy in parts of
#: log2(tokens), of which at most ENTROPY_TOKENS count. Measured with the default vocabulary on public text, translated
#: messages of free software in 78 languages (of at least 100 texts of 800 characters, or 10 where a script has none of
#: these), never on the documents to be judged:
#: 0.9 times the least 5th percentile of a language of the script, 1.3 times the largest 95th, the largest 95th plus
#: 0.05, the least 5th. Text without letters gets the widest of each.
BANDS = {
    "latin": (1.3, 6.1, 0.18, 0.64), "cyrillic": (1.47, 3.7, 0.14, 0.67), "greek": (0.9, 1.8, 0.10, 0.51), "hebrew": (0.83, 1.3, 0.29, 0.48), "arabic": (0.84, 1.7, 0.24, 0.51),
    "indic": (0.33, 1.7, 0.99, 0.38), "kana": (0.92, 2.3, 0.16, 0.68), "han": (0.9, 2.5, 0.31, 0.70), "hangul": (0.87, 2.2, 0.24, 0.65), "other": (0.58, 2.0, 0.61, 0.49), "none": (0.33, 6.1, 0.99, 0.38),
}
ENTROPY_TOKENS = 512
#: Base rules: least words; most percent of words that lie in repeated windows of three words.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


def _table(marks: dict[int, int], size: int = 256) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, v in marks.items():
        out[k] = v
    return out


SCRIPT_OF = _table({b: SCRIPTS.index(s) for s, ranges in LEAD_BYTES.items() for lo, hi in ranges for b in range(lo, hi + 1)})
IS_SYMBOL = _table({b: 1 for b in SYMBOLS}).astype(bool)
IS_SPACE = _table({b: 1 for b in b" \t\n\v\f\r"}).astype(bool)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags within each row's bytes."""
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    base = len(ids)
    pairs = np.unique(w[:-1] * base + w[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * base + w[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def token_measures(texts: list[str], processor, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and entropy in bits of each text."""
    coded = [np.asarray(x, np.int64) for x in processor.encode(texts, num_threads=1)]
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    ids = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(coded)), n)
    fallback = np.bincount(row, is_byte[ids], minlength=len(coded)).astype(np.int64)
    keys, counts = np.unique(row * len(is_byte) + ids, return_counts=True)
    owner = keys // len(is_byte)
    weighted = np.bincount(owner, counts * np.log2(counts), minlength=len(coded))
    entropy = np.where(n > 0, np.log2(np.maximum(n, 1)) - weighted / np.maximum(n, 1), 0.0)
    return n, fallback, entropy


def measure(texts: pa.Array, processor, is_byte: np.ndarray, bands: dict) -> dict[str, np.ndarray]:
    """All columns of SCHEMA for one slice of texts."""
    data, offsets = byte_view(texts)
    whole = data.tobytes()
    raw = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    words = [x.split() for x in raw]
    n_words = np.fromiter(map(len, words), np.int64, len(raw))
    starts = (data & 0xC0) != 0x80
    points = per_row(starts, offsets)
    repeat = np.fromiter(map(repeated_words, words), np.int64, len(raw))
    base_failed = (n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n_words)
    kinds = SCRIPT_OF[data]
    by_script = np.stack([per_row(kinds == k, offsets) for k in range(1, len(SCRIPTS))])
    script = np.where(by_script.max(axis=0) > 0, by_script.argmax(axis=0) + 1, 0)
    n_tokens, fallback, entropy = token_measures([x.decode() for x in raw], processor, is_byte)
    chars = np.where(n_tokens > 0, points / np.maximum(n_tokens, 1), 0.0)
    share = np.where(n_tokens > 0, fallback / np.maximum(n_tokens, 1), 0.0)
    low, high, most_bytes, least = np.array([bands.get(s, bands["other"]) for s in SCRIPTS]).T[:, script]
    floor = least * np.log2(np.clip(n_tokens, 1, ENTROPY_TOKENS))
    passed = (chars >= low) & (chars <= high) & (share <= most_bytes) & (entropy >= floor)
    return {
        "n_words": n_words, "word_chars": points - per_row(IS_SPACE[data], offsets), "n_symbols": per_row(IS_SYMBOL[data], offsets),
        "n_dup_lines": np.fromiter(map(duplicate_lines, raw), np.int64, len(raw)), "n_repeat_words": repeat, "base_failed": base_failed, "kept": ~base_failed & passed,
        "script": np.array(SCRIPTS, object)[script], "n_tokens": n_tokens, "chars_per_token": chars.round(6), "byte_share": share.round(6), "token_entropy": entropy.round(6),
    }


def fertility(docs: DataFrame, vocabulary: str = VOCABULARY, bands: dict | None = None, text: str = "text") -> DataFrame:
    """docs plus the columns of SCHEMA (replacing columns of those names). One pass over the texts, no shuffle."""
    from pyspark.sql import types as T

    added = T._parse_datatype_string(SCHEMA)
    docs = docs.drop(*(c for c in added.names if c != text))
    schema = T.StructType(docs.schema.fields + added.fields)
    bands = BANDS if bands is None else bands
    with open(vocabulary, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        is_byte = np.array([processor.is_byte(i) for i in range(processor.get_piece_size())], float)
        for piece in slices(batches, text):
            found = measure(piece.column(text), processor, is_byte, bands)
            yield pa.RecordBatch.from_arrays(piece.columns + [pa.array(found[c]) for c in added.names], names=piece.schema.names + added.names)

    return docs.mapInArrow(run, schema)


def op10_fertility(spark, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and the verdict for every document."""
    return fertility(clash_free(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")).drop("text")
