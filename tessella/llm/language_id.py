"""Hierarchical language identification.

A multinomial logistic model over hashed byte n-grams picks the language family; inside a family with several learned
languages, one-versus-one linear support vector machines vote. All models are fitted here, on a bounded sample:
every language, and about SAMPLE documents of each, drawn by a hash of the identifier. The family model is fitted in the
driver on about FAMILY_ROWS of these; each pair of languages is a group of its own, fitted on the executors.

Defined results: null text and text without a letter give `und` with score 0; a language without a known family is a
family of its own; null identifiers are never learned from and not held out; if nothing can be learned all rows are
`und`; ties go to the language first by code point; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import clash_free, materialize, release, slices

#: Hashed features; documents sampled per language; most of them, evenly over the families, for the family model.
BUCKETS, SAMPLE, FAMILY_ROWS = 4096, 400, 16_000
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "uralic": "fi et hu", "celtic": "ga gd cy br", "hellenic": "el", "turkic": "tr az kk ky uz tk tt", "semitic": "ar he mt am",
    "iranian": "fa ku ps tg", "indic": "hi bn ur mr gu pa ne si", "dravidian": "ta te kn ml", "sinitic": "zh", "japonic": "ja", "koreanic": "ko", "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
PLAIN = re.compile("[A-Za-z]")
#: Bytes as features see them: letters and non-ASCII bytes stay, all else is a space.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
CHUNK = 1 << 20


def grams(text: str) -> np.ndarray:
    """Unit-length vector of square roots of hashed 1- to 4-gram counts of the folded text."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(FOLD) + b" "
    out = np.zeros(BUCKETS, np.float64)
    for start in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[start : start + CHUNK + 3], np.uint8).astype(np.uint32)
        full = min(CHUNK, len(raw) - start)
        key = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            m = len(b) - n + 1
            if m <= 0:
                break
            key = key[:m] * np.uint32(0x01000193) + b[n - 1 : n - 1 + m] + np.uint32(n)
            mixed = (key[: min(full, m)] * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount(mixed, minlength=BUCKETS)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter (Unicode category L)."""
    return bool(text) and (PLAIN.search(text) is not None or any(c.isalpha() for c in set(text)))


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 8.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (features + 1, classes) by full-batch gradient steps with momentum; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, speed = np.zeros((x.shape[1], classes), np.float32), np.float32(0)
    weight = ((1.0 / np.bincount(y, minlength=classes).clip(1))[y] / classes).astype(np.float32)
    rate, decay = np.float32(rate), np.float32(decay)
    for _ in range(rounds):
        p = softmax(x @ w)
        p[np.arange(len(y)), y] -= 1
        speed = np.float32(0.9) * speed - rate * (x.T @ (p * weight[:, None]) + decay * w)
        w = w + speed
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Linear L2-loss support vector machine by dual coordinate descent; y in {-1, 1}; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    diagonal = 0.5 / cost
    curvature = (x * x).sum(axis=1) + diagonal
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + diagonal * alpha[i]) / curvature[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit_families(x: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray | None]:
    """Families in order and the weights between them."""
    families = sorted({FAMILY_OF.get(c, c) for c in langs})
    place = {f: i for i, f in enumerate(families)}
    of = np.array([place[FAMILY_OF.get(c, c)] for c in langs])
    return families, fit_softmax(x, of, len(families)).astype(np.float32) if len(families) > 1 else None


def fit_pair(rows: pa.Table) -> pa.Table:
    """The machine between the languages of one group of rows (a, b, lang, x)."""
    a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    told = sorted(zip(rows.column("lang").to_pylist(), rows.column("x").to_pylist()))
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for _, v in told])
    w = fit_svm(x, np.array([1.0 if c == a else -1.0 for c, _ in told])).astype(np.float32)
    return pa.table({"a": pa.array([a], pa.string()), "b": pa.array([b], pa.string()), "w": pa.array([w.tobytes()], pa.binary())})


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each feature row; the score is the family's probability times the mean pairwise one."""
    one = np.hstack([x, np.ones((len(x), 1), np.float32)])
    p = softmax(one @ model["weights"]) if model["weights"] is not None else np.ones((len(x), 1))
    family, out, score = p.argmax(axis=1), np.empty(len(x), object), np.zeros(len(x))
    for k, (members, pairs) in enumerate(model["families"]):
        rows = np.flatnonzero(family == k)
        if not len(rows):
            continue
        votes, trust = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        for i, j, w in pairs:
            margin = one[rows] @ w
            votes[:, i] += margin >= 0
            votes[:, j] += margin < 0
            sure = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
            trust[:, i] += sure
            trust[:, j] += 1 - sure
        best = (votes + 1e-3 * trust).argmax(axis=1)
        out[rows] = np.array(members, object)[best]
        score[rows] = p[rows, k] * (trust[np.arange(len(rows)), best] / max(len(members) - 1, 1) if pairs else 1.0)
    return out.tolist(), np.clip(score, 0, 1)


def remainder(key: Column, divisor: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % divisor


def train(docs: DataFrame, sample: int = SAMPLE, family_rows: int = FAMILY_ROWS) -> dict | None:
    """Fit on doc_id, text, lang. Languages are counted without the texts, then sampled texts become features on the
    executors, written to the shared folder. The driver gets about family_rows feature vectors and a machine for each
    pair of languages of a family; a pair's group has about 2 * sample vectors."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(counts), "lang").filter(mark < F.lit(float(sample)) / F.col("_n"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            texts, langs, marks = (piece.column(c).to_pylist() for c in ("text", "lang", "mark"))
            kept = [(c, m, grams(t).astype(np.float16).tobytes()) for t, c, m in zip(texts, langs, marks) if has_letter(t)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([c for c, _, _ in kept], pa.string()), "mark": pa.array([m for _, m, _ in kept], pa.int64()), "x": pa.array([v for _, _, v in kept], pa.binary())})

    again = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)).alias("mark")
    drawn = materialize(chosen.select("lang", "text", again).mapInArrow(features, "lang string, mark long, x binary"), "samples")
    sizes = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    families: dict[str, list[str]] = {}
    for c in sorted(sizes):
        families.setdefault(FAMILY_OF.get(c, c), []).append(c)
    rates = [(c, min(1.0, family_rows / len(families) / sum(sizes[m] for m in members))) for members in families.values() for c in members]
    rates = spark.createDataFrame([(c, int(r * (1 << 30))) for c, r in rates], "lang string, rate long")
    got = sorted((r["lang"], bytes(r["x"])) for r in drawn.join(F.broadcast(rates), "lang").filter("mark < rate").select("lang", "x").collect())
    x = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    names, weights = fit_families(x, [c for c, _ in got])
    model = {"families": [(families[f], []) for f in names], "weights": weights}

    pairs = [(a, b, c) for members in families.values() for i, a in enumerate(members) for b in members[i + 1 :] for c in (a, b)]
    if pairs:
        asked = spark.createDataFrame(pairs, "a string, b string, lang string")
        fitted = drawn.join(F.broadcast(asked), "lang").select("a", "b", "lang", "x").groupBy("a", "b").applyInArrow(fit_pair, "a string, b string, w binary")
        home = {c: (i, j) for i, f in enumerate(names) for j, c in enumerate(families[f])}
        for a, b, w in sorted((r["a"], r["b"], bytes(r["w"])) for r in fitted.collect()):
            model["families"][home[a][0]][1].append((home[a][1], home[b][1], np.frombuffer(w, np.float32)))
    release(drawn)
    return model


def identify(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score from the text alone. The model's size is fixed by BUCKETS and the languages."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string("lang_pred string, score double").fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            texts = piece.column(text).to_pylist()
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if has_letter(t)] if shared.value else []
            for at in range(0, len(told), 256):
                part = told[at : at + 256]
                langs[part], scores[part] = predict(shared.value, np.stack([grams(texts[i]) for i in part]))
            yield pa.RecordBatch.from_arrays(piece.columns + [pa.array(langs.tolist(), pa.string()), pa.array(scores.round(6))], names=piece.schema.names + ["lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; every fifth by crc32 of its identifier is held out from learning."""
    docs = clash_free(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    left = remainder(F.col("doc_id"), 5)
    model = train(docs.filter(left != 0))
    out = identify(docs.select("doc_id", "text", F.coalesce(left == 0, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
