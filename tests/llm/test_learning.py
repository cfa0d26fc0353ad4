"""The classifiers' parts against plain versions of their definitions."""

import math
import random

import numpy as np

from punctuality.llm import quality, toxicity

MASK = 0xFFFFFFFF


def plain_ftrl(samples, passes):
    """Coordinate by coordinate, as the algorithm is stated."""
    z, n, bias = {}, {}, 1 << quality.BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(passes):
        for y, slots, values in samples:
            x = {**dict(zip(slots.tolist(), values.tolist())), bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, before = (p - y) * v, n.get(i, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}, weight(bias)


def test_follow_the_regularised_leader():
    rng = random.Random(20)
    texts = [" ".join(rng.choice("good fine Bad! the a of x1".split()) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    samples = [(int("good" in t), *quality.features(t)) for t in texts] + [(1, *quality.features(""))]
    want, want_bias = plain_ftrl(samples, 3)
    weights, bias = quality.ftrl(samples, 3)
    assert abs(bias - want_bias) < 1e-9
    at = [i for i in want if i != 1 << quality.BITS]
    assert np.allclose(weights[at], [want[i] for i in at], atol=1e-6) and np.count_nonzero(weights) == sum(want[i] != 0 for i in at) > 10


def test_words_and_their_order_are_features():
    """Texts of equal words or equal shapes differ by their word 2- and 3-grams."""
    one, other = quality.features("red fox saw blue cat"), quality.features("red cat saw blue fox")
    assert set(one[0].tolist()) != set(other[0].tolist())
    slots, values = quality.features("word")
    assert len(slots) == 3 and np.allclose(values, quality.SCALE)
    assert len(quality.features(" \n")[0]) == 0


def slot(gram, n):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) & MASK
    x = ((h ^ (n * 0x85EBCA6B & MASK)) * 0x9E3779B1) & MASK
    return (((x ^ (x >> 16)) * 0x2C1B3C6D) & MASK) >> (32 - toxicity.BITS)


def test_character_grams():
    """n-grams are of characters, whatever their number of bytes."""
    text = "Ünï,  中文 \U0001f600!"
    shown = " ünï 中文 \U0001f600 "
    got = {n: sorted(slots.tolist()) for n, slots in toxicity.grams(toxicity.plain(text))}
    assert got == {n: sorted(slot(shown[i : i + n], n) for i in range(len(shown) - n + 1)) for n in toxicity.ORDERS if len(shown) >= n}


def test_log_count_ratios():
    """Smoothed rates of texts that hold a gram, toxic over other, where they tell enough."""
    rng = random.Random(21)
    samples = [(y, " ".join(rng.choice(("vile rot you" if y else "kind day you").split()) for _ in range(6))) for y in [0, 1] * 40] + [(0, ""), (1, "")]
    seen, texts = toxicity.count(samples)
    ratio = toxicity.ratios(seen, texts)
    sets = [(y, {(n, slot(s[i : i + n], n)) for s in [" " + " ".join(t.split()) + " "] if t for n in toxicity.ORDERS for i in range(len(s) - n + 1)}) for y, t in samples]
    for at in {k for _, s in sets for _, k in s}:
        held = [sum(any(k == at for _, k in s) for y, s in sets if y == c) for c in (0, 1)]
        rate = [(held[c] + toxicity.SMOOTH) / (41 + 2 * toxicity.SMOOTH) for c in (0, 1)]
        want = math.log(rate[1] / rate[0])
        tells = abs(want) >= toxicity.INFORMATIVE and sum(held) >= toxicity.LEAST
        assert abs(ratio[at] - (want if tells else 0)) < 1e-5
    scores = toxicity.score_texts(["vile rot", "kind day", ""], *toxicity.fit([(y, *toxicity.scaled(t, ratio)) for y, t in samples], ratio))
    assert scores[0] > 0.9 > 0.5 > scores[1]


def test_labels_of_one_kind_say_that_kind(spark):
    from punctuality.llm import toxicity

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(40)], "doc_id long, toxic int")
        assert {r["predicted"] for r in toxicity.toxicity(docs, labels).collect()} == {kind}
