import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import fertility as fe
from tessella.llm import language_id as li
from tessella.llm import longest_match as lm
from tessella.llm import toxicity as tx

SPACE = " \t\n\v\f\r"


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    langs = [f"x{i}" for i in range(70)]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for c in langs}
    rows = [(10 * i + k, " ".join(rng.choices(words[c], k=40)), c) for i, c in enumerate(langs) for k in range(3 if i < 64 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df)
    assert {c for members, _ in model["families"] for c in members} == set(langs)
    assert all(r["lang_pred"] == r["lang"] for r in li.identify(df, model).collect())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    t = text or ""
    w = words_of(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in t.split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, None if covered is None else len(covered)


def test_base_rules_equal_brute_force(docs, corpus):
    got = fe.fertility(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        n, chars, symbols, dup, repeat = base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (n, chars, symbols)
        assert dup in (None, r["n_dup_lines"]) and repeat in (None, r["n_repeat_words"])
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_token_measures(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=fe.VOCABULARY)
    for r in fe.fertility(docs.filter(F.length("text") < 3000)).collect():
        ids = sp.encode(r["text"])
        p = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
        assert r["n_tokens"] == len(ids)
        assert r["token_entropy"] == pytest.approx(float(-(p * np.log2(p)).sum()), abs=1e-5)
        assert r["byte_share"] == pytest.approx(sum(sp.is_byte(i) for i in ids) / max(len(ids), 1), abs=1e-5)


def test_bands_reject_by_script(spark):
    clean = """In the morning the old fisherman walked down to the harbour and looked at the grey water. Nobody else was awake yet, and
    the gulls cried above the empty market stalls while a thin wind carried the smell of bread from the bakery behind the church. He
    thought about his daughter, who had left for the city last winter, and wondered whether her letters would ever arrive again."""
    russian = """Утром старый рыбак спустился к гавани и долго смотрел на серую воду. Никто ещё не проснулся, только чайки кричали над
    пустыми прилавками рынка, а слабый ветер приносил запах хлеба из пекарни за церковью. Он думал о дочери, которая прошлой зимой
    уехала в город, и спрашивал себя, придут ли когда-нибудь её письма, о которых она обещала ему в последний вечер перед отъездом."""
    rows = [(1, clean), (2, " ".join(f"a{'b' * (i % 7)}c" for i in range(300))), (3, russian)]
    got = {r["doc_id"]: (r["script"], r["kept"]) for r in fe.fertility(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("latin", True) and not got[2][1] and got[3] == ("cyrillic", True)


def greedy(pieces, word):
    n, at = 0, 0
    longest = max(map(len, pieces))
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + k] in pieces:
                n, at = n + 1, at + k
                break
        else:
            return -1
    return n


@pytest.mark.parametrize("seed", range(8))
def test_automaton_equals_greedy_matching(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(2, 40))} | ({b"a", b"b", b"c"} if seed % 2 else set())
    a = lm.build(pieces)
    words = [bytes(rng.choice(b"abcd" if seed % 3 == 0 else b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    want = [greedy(pieces, w) for w in words]
    assert lm.count_together(a, words).tolist() == want
    edges = dict(zip(a.edges.tolist(), a.to.tolist()))
    assert [lm.count_one(edges, a, w) for w in words] == want


def test_token_counts_of_documents(docs, corpus):
    pieces = set(lm.read_vocabulary(lm.VOCABULARY))
    got = lm.token_counts(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        w = [b" " + x.encode() for x in words_of(r["text"])]
        assert r["n_words"] == len(w) and r["n_unknown"] == 0
        if len(w) < 400:
            assert r["n_tokens"] == sum(greedy(pieces, x) for x in w)


def test_nothing_in_nothing_out(nothing):
    assert fe.fertility(nothing).count() == lm.token_counts(nothing).count() == 0
    assert li.train(nothing) is None and li.identify(nothing, None).count() == 0
    labels = nothing.select("doc_id", F.lit(1).alias("toxic"))
    assert tx.score(nothing, tx.train(nothing, labels)).count() == 0


SAMPLES = {"en": "the and of with that this garden have will from", "de": "der und die das nicht mit ein garten haben für", "fr": "le et les des une avec dans jardin être pour", "es": "el y los de una con en jardín ser para"}


def language_rows():
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(SAMPLES[c].split()) for _ in range(rng.randrange(8, 60))), c) for i, c in enumerate(rng.choices(list(SAMPLES), k=400))]


def test_languages_held_out(spark, tmp_path):
    rows = language_rows() + [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "le jardin et les roses " * 20000, "fr"), (None, "the garden", "en"), (5, "the garden", "en"), (5, "the garden", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = li.op3_language(spark, str(tmp_path)).collect()
    truth = {r[0]: r[2] for r in language_rows()}
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002)) and by[1003]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_long_text_features_are_whole(monkeypatch):
    text = " ".join(random.Random(1).choice(SAMPLES["en"].split()) for _ in range(3000))
    whole = li.grams(text)
    monkeypatch.setattr(li, "CHUNK", 257)
    assert np.allclose(whole, li.grams(text), atol=1e-6)


BASE = {"t": 1.0, "0": 1.5, "5": 4.0, "7": 6.0}
SCALED = {"p": 1.0, "d": 1.25, "y": 0.5, "x": 0.25}


def test_composed_grammar():
    machine = tx.grammar(BASE, SCALED)
    score = lambda c: tx.best_path(machine, c)[0]
    assert score("o5o") == 4.0 and score("opo5") == score("5op") == 5.0
    assert score("no5") == 1.0 and score("noo5") == 1.0 and score("nooo5") == 4.0
    assert score("rooooo5") == 2.0 and score("tp") == 1.25 and score("t") == 0.0 and score("ntp") == 0.0
    assert score("5o7") == 10.0 and score("n5p") == 1.0
    assert score("") == 0 and not math.isinf(score("opnr0tp5" * 5))


def all_paths(machine, clause, state=0):
    """Weight and output of every path from a state that reads the clause and ends in a final state."""
    arcs, final = machine
    if not clause:
        return [(0.0, ())] if state in final else []
    return [(w + more, ((out,) if out != "o" else ()) + told) for out, w, to in arcs.get((state, clause[0]), []) for more, told in all_paths(machine, clause[1:], to)]


def test_best_path_is_the_best_of_all_paths():
    rng, machine = random.Random(4), tx.grammar(BASE, SCALED)
    for _ in range(300):
        clause = "".join(rng.choice("oopnrt0557") for _ in range(rng.randrange(9)))
        paths = all_paths(machine, clause)
        got = tx.best_path(machine, clause)
        assert paths and got[0] == pytest.approx(max(w for w, _ in paths)) and any(got[1] == told and w == pytest.approx(got[0]) for w, told in paths)


def test_composition_equals_the_cascade():
    """One composed machine weighs as the transducers do one after the other."""
    rng = random.Random(6)
    parts = [tx.insults(BASE), tx.negation(), tx.reported(), tx.directed(), tx.scorer(BASE, SCALED)]

    def cascade(clause):
        tapes = [((), 0.0, tuple(clause))]
        for arcs, final in parts:
            after = []
            for _, weight, tape in tapes:
                heads = [((), weight, 0)]
                for c in tape:
                    heads = [(told + (out,), w + more, to) for told, w, s in heads for out, more, to in arcs.get((s, c), [])]
                after += [((), w, told) for told, w, s in heads if s in final]
            tapes = after
        return max(w for _, w, _ in tapes)

    machine = tx.grammar(BASE, SCALED)
    for _ in range(100):
        clause = "".join(rng.choice("oopnrt057") for _ in range(rng.randrange(1, 8)))
        assert tx.best_path(machine, clause)[0] == pytest.approx(cascade(clause))


def test_idle_runs_do_not_matter():
    rng, machine = random.Random(8), tx.grammar(BASE, SCALED)
    for _ in range(200):
        clause = "".join(rng.choice(["o" * rng.randrange(9), *"pnrt57"]) for _ in range(8))
        short, long = tx.best_path(machine, tx.IDLE.sub("o" * (tx.REACH + 1), clause)), tx.best_path(machine, clause)
        assert short[0] == pytest.approx(long[0]) and short[1] == long[1]


def test_scores_follow_the_grammar(monkeypatch):
    """Directed, plain, reported and negated insults rank in this order; without the grammar no text is scored."""
    model = {"levels": {"snarf$": "7", "grubb": "5"}, "base": BASE, "scales": SCALED, "weights": [-4.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.5]}
    reader = tx.Reader(model)
    score = lambda t: float(reader.features(t) @ np.array(model["weights"]))
    for w in ("snarf", "grubble"):
        texts = [f"you are a {w} indeed", f"here is a {w} indeed", f"he wrote that some big old fat {w} came", f"this is not a {w} indeed"]
        found = [score(t) for t in texts]
        assert found == sorted(found, reverse=True) and len(set(found)) == 4
    for text in ("i will kill them", "they will destroy you"):
        assert score(text) > score(text.replace("kill", "k").replace("destroy", "d")) == score("the letter is here")
    monkeypatch.setattr(tx, "best_path", lambda machine, clause: (0.0, ()))
    reader.known.clear()
    assert score("you are a snarf") == -4.0


def test_heavier_paths_never_lower_the_score(spark):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(500, tx.FEATURES)))
    x[:, 0] = 1
    y = (x[:, 5] - x[:, 2] + rng.normal(size=500) > 0).astype(float)
    w = tx.fit_rising(x, y, np.ones(500))
    assert (w[[f for f in range(tx.FEATURES) if f not in tx.FREE]] >= 0).all() and w[5] > 0 and w[2] == 0


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(9)
    calm = "river stone cloud forest garden window letter market".split()
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(calm) + "." * (rng.random() < 0.1) for _ in range(rng.randrange(20, 80))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["snarf", "grubble", "zoxish"]) + rng.choice(["", "ed", "en"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    extra = [(900, None), (901, ""), (902, "snarf " * 50000), (None, "snarf"), (3, rows[3][1])]
    spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels + [(None, 1), (7, None), (8, labels[8][1])], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = tx.op7_toxicity(spark, str(tmp_path)).collect()
    truth = dict(labels)
    assert len(got) == len(rows) + len(extra)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in (900, 901, 902)} == {900: 0, 901: 0, 902: 1}


def test_labels_of_one_kind(spark, nothing):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert all(r["score"] == pytest.approx(0.25) for r in tx.score(docs, model).collect())


def test_numerals_are_no_letters(spark):
    assert not any(map(li.has_letter, ("½ ² Ⅷ", "١٢٣ _", "", None, "!?" * 9))) and all(map(li.has_letter, ("½ a", "ß", "語", "१ क")))
    rows = [(i, t, c) for i, t, c in language_rows()] + [(2000, "½ ² Ⅷ", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.identify(df, li.train(df)).filter("doc_id = 2000").collect()} == {"und"}


def test_prediction_by_hand():
    """Family probability, pairwise votes and trust of a small model, recomputed one row at a time."""
    rng = np.random.default_rng(5)
    model = {"families": [(["a", "b", "c"], [(i, j, rng.normal(size=7).astype(np.float32)) for i, j in ((0, 1), (0, 2), (1, 2))]), (["z"], [])], "weights": rng.normal(size=(7, 2)).astype(np.float32)}
    x = rng.normal(size=(200, 6)).astype(np.float32)
    names, scores = li.predict(model, x)
    for row, name, score in zip(x, names, scores):
        one = [*map(float, row), 1.0]
        z = [math.exp(sum(v * float(model["weights"][k, f]) for k, v in enumerate(one))) for f in (0, 1)]
        f = int(z[1] > z[0])
        members, pairs = model["families"][f]
        votes, trust = [0.0] * len(members), [0.0] * len(members)
        for i, j, w in pairs:
            margin = sum(v * float(u) for v, u in zip(one, w))
            sure = 1 / (1 + math.exp(-2 * margin))
            votes[i] += margin >= 0
            votes[j] += margin < 0
            trust[i] += sure
            trust[j] += 1 - sure
        best = max(range(len(members)), key=lambda k: (votes[k] + 1e-3 * trust[k], -k))
        assert name == members[best]
        assert score == pytest.approx(z[f] / sum(z) * (trust[best] / 2 if pairs else 1.0), abs=1e-4)


def test_machine_is_at_the_optimum():
    """The dual's solution has no slope in the primal: ridge and squared hinge balance."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = li.fit_svm(x, y, cost=0.5, epochs=400)
    one = np.hstack([x, np.ones((60, 1))])
    slack = np.maximum(0, 1 - y * (one @ w))
    assert np.abs(w - 2 * 0.5 * ((slack * y)[:, None] * one).sum(axis=0)).max() < 1e-3


def test_the_family_model_is_bounded(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df, family_rows=60)
    got = li.identify(df, model).collect()
    assert [m for m, _ in model["families"]] == [["de", "en"], ["es", "fr"]] and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95


#: Article 1 of the Universal Declaration of Human Rights, public text.
DIGNITY = {
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
    "Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "han": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
}


def outside(row):
    """The measures of a row that lie outside their band."""
    low, high, most, least = fe.BANDS[row["script"]]
    bits = least * math.log2(min(max(row["n_tokens"], 1), fe.ENTROPY_TOKENS))
    return {n for n, bad in (("few", row["chars_per_token"] < low), ("many", row["chars_per_token"] > high), ("bytes", row["byte_share"] > most), ("entropy", row["token_entropy"] < bits)) if bad}


def test_public_text_of_each_script_lies_in_its_band(spark):
    rows = list(DIGNITY.items())
    got = fe.fertility(spark.createDataFrame(rows, "name string, text string")).collect()
    assert {r["name"]: r["script"] for r in got} == {s: s for s in DIGNITY}
    assert all(not outside(r) for r in got)


def test_each_measure_rejects(spark):
    """What each band is there for, in texts that the base rules pass."""
    rng = random.Random(1)
    mash = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ0123456789") for _ in range(12)) for _ in range(80))
    rare = " ".join(rng.choice("abcdefghi") + "".join(chr(rng.randrange(0x250, 0x2AF)) for _ in range(3)) for _ in range(90))
    wide = " ".join(rng.choice(["international", "development", "information", "government", "environment", "administration", "organization", "communication"]) for _ in range(40)) + " " + " ".join(f"{'=' * 64} word{i}" for i in range(40))
    few = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what".split()
    dull = " ".join(rng.choice(few[:6]) if rng.random() < 0.93 else rng.choice(few) for _ in range(600))
    rows = [("few", mash), ("bytes", rare), ("many", wide), ("entropy", dull)]
    got = {r["name"]: r for r in fe.fertility(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert not any(got[n]["kept"] for n, _ in rows)
    assert all(n in outside(got[n]) for n, _ in rows), {n: (outside(r), r["chars_per_token"], r["byte_share"], r["token_entropy"], r["n_tokens"]) for n, r in got.items()}


def test_long_words_are_not_remembered():
    counter = lm.Counter(lm.build(lm.read_vocabulary(lm.VOCABULARY)))
    long = bytes(random.Random(1).choices(b"abcdefgh", k=5000))
    first = [x.tolist() for x in counter.count([b"one two " + long, long])]
    assert max(map(len, counter.known)) <= lm.LONG_WORD and first == [x.tolist() for x in counter.count([b"one two " + long, long])]
