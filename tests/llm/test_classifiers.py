import random

import pytest

from factloom.llm import quality, toxicity
from factloom.llm.labels import held_out

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        words = ["".join(rng.choice(["ta", "ko", "mi", "re", "su"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grubber", "snotbag", "gr\u0443bber", "5notb4g"]))
        if bad:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("kind, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy_and_determinism(labelled, kind, label):
    docs, labels = labelled
    score = kind.score_quality if kind is quality else kind.score_toxicity
    runs = [{r.doc_id: (r.score, r.predicted) for r in score(docs, kind.learn(docs, labels)).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    truth = {r.doc_id: r[label] for r in labels.where(held_out()).collect()}
    assert sum(runs[0][i][1] == y for i, y in truth.items()) >= 0.97 * len(truth)
    assert all(0 <= s <= 1 for s, _ in runs[0].values())


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, odd, none, labelled, kind):
    score = kind.score_quality if kind is quality else kind.score_toxicity
    empty = spark.createDataFrame([], LABELS)
    for model in (kind.learn(odd, empty), kind.learn(*labelled)):
        got = score(odd, model).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert score(none, model).count() == 0


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_clashing_columns(odd, labelled, kind):
    from pyspark.sql import functions as F

    more = odd.withColumns({"Score": F.lit("x"), "predicted": F.lit("y"), "held_out": F.lit("z"), "label": F.lit("w")})
    model = kind.learn(*labelled)
    got = kind.accepted(more, model)
    assert got.columns == more.columns and all(r.predicted == "y" for r in got.collect())
    score = kind.score_quality if kind is quality else kind.score_toxicity
    assert all(r.predicted in (0, 1) for r in score(more, model).collect())
    kind.learn(more, labelled[1])


def test_folding_and_exceptions(spark):
    lex = toxicity.Lexicon({toxicity.fold("clown"): 5.0}, toxicity.EXCEPTIONS, None)
    a = lex.automaton()
    hits = lambda t: toxicity.evidence(a, t)[3]
    assert hits("you cl0wn, CLOWN! \u0441lown") == 3 and hits("clownish unclown") == 0 and hits("a clown fish") == 0
    texts = ["CL0WN \uff43lown", "\u0405tupid 1d10t", "plain l\u200bower"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(toxicity.fold_column("text")).collect()] == [toxicity.fold(t) for t in texts]


def test_machine_scores_by_the_pair_sum(labelled):
    import numpy as np

    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)), None)
    idx, x = rng.permutation(quality.FEATURES)[:7], rng.normal(size=7)
    z, _ = quality.raw_scores(m, idx, x, np.array([0, 7]))
    pairs = sum(m.factors[idx[i]] @ m.factors[idx[j]] * x[i] * x[j] for i in range(7) for j in range(i))
    assert np.isclose(z[0], m.bias + m.linear[idx] @ x + pairs)


def test_many_hits_and_phrases_take_time_in_proportion():
    """A text of 900,000 characters, half of it spared: the same as judging each hit against all phrases, without the square."""
    import time

    lex = toxicity.Lexicon({toxicity.fold("clown"): 5.0, toxicity.fold("fish"): 1.0}, toxicity.EXCEPTIONS, None)
    a = lex.automaton()
    start = time.time()
    weight, distinct, words, hits = toxicity.evidence(a, "a clown fish and a clown " * 36_000)
    assert (weight, distinct, hits) == (36_000 * 5.0, 1.0, 36_000) and words == 216_001
    assert time.time() - start < 20


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_very_long_texts(spark, labelled, kind):
    model = kind.learn(*labelled)
    score = kind.score_quality if kind is quality else kind.score_toxicity
    df = spark.createDataFrame([(1, "grubber " + "tako misu " * 200_000, 1), (2, "x" * 1_500_000, 1), (3, "", 1), (1, "tako", 2)], "doc_id long, text string, n int")
    assert all(0 <= r.score <= 1 for r in score(df, model).collect())


def test_training_rows_are_one_a_document(spark):
    from factloom.llm.labels import training_rows

    ids = [i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {k}") for i in ids[:20] for k in range(3)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[:20]] + [(ids[0], 0, 0), (ids[1], 1, 0), (None, 1, 1), (ids[2], None, 1)], "doc_id long, quality int, toxic int")
    got = training_rows(docs, labels, "quality", 10).collect()
    assert len(got) <= 10 and len({r.doc_id for r in got}) == len(got) and {r.text for r in got} == {"text 0"}
    assert {r.doc_id for r in training_rows(docs, labels, "quality", 100).collect()} == set(ids[1:20])


def test_quality_scores_by_a_plain_form(spark, labelled):
    """Scores again, text by text, with dicts and a double loop over pairs in place of arrays and sums of squares."""
    import math
    import re

    import numpy as np

    from factloom.llm.common import span_hashes

    m = quality.learn(*labelled)
    texts = [r.text for r in labelled[0].limit(5).collect()] + ["", "One  two two\nTWO!! 3"]
    got = [r.score for r in quality.score_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), m).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        data = text.encode()
        words = re.findall(rb"[0-9a-z\x80-\xff]+", data.lower())
        index = {}
        for w in words:
            h = int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 64 - quality.BITS
            index[h] = index.get(h, 0) + 1
        size, n = max(len(data), 1), max(len(words), 1)
        share = lambda p: len(re.findall(p, data)) / size
        sign = rb"[!-/:-@\[-`{-~]"
        stats = [share(rb"[A-Z]"), share(rb"[0-9]"), share(sign), share(rb"[\x80-\xff]"), share(rb"\n"), sum(map(len, words)) / n, len(index) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(index.values(), default=0) / n, sum(len(w) <= 3 for w in words) / n, math.log1p(len(data)), sum(data[k] == data[k - 1] and re.match(sign, data[k : k + 1]) is not None for k in range(1, len(data))) / size]
        x = {h: math.log1p(c) for h, c in index.items()}
        norm = math.sqrt(max(sum(v * v for v in x.values()), 1e-9))
        x = {h: v / norm for h, v in x.items()} | {quality.WORDS + s * quality.BINS + sum(e < v for e in m.edges[s]): 1.0 for s, v in enumerate(stats)}
        keys = sorted(x)
        z = m.bias + sum(m.linear[k] * x[k] for k in keys) + sum(float(m.factors[i] @ m.factors[j]) * x[i] * x[j] for i in keys for j in keys if i < j)
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_toxicity_scores_by_a_plain_form(spark, labelled):
    """Scores again with a search for each word of the lexicon in place of the automaton."""
    import math
    import re

    lex = toxicity.learn(*labelled)
    texts = [r.text for r in labelled[0].limit(30).collect()] + ["", "GRUBBER gr\u0443bber grubbers x5notb4g 5notb4g, trash can"]
    got = [r.score for r in toxicity.score_toxicity(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), lex).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        t = toxicity.fold(text)
        spans = [m.span() for p in map(toxicity.fold, lex.exceptions) for m in re.finditer(rf"(?<![^\W\d_]){re.escape(p)}(?![^\W\d_])", t)]
        hits = [(w, m.span()) for w in lex.weights for m in re.finditer(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", t)]
        hits = [(w, s) for w, s in hits if not any(a <= s[0] and s[1] <= b for a, b in spans)]
        weight, n = sum(lex.weights[w] for w, _ in hits), t.count(" ") + t.count("\n") + 1
        c = lex.coefficients
        z = c[0] + c[1] * math.log1p(weight) + c[2] * math.log1p(100 * weight / n) + c[3] * math.log1p(len({w for w, _ in hits}))
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
