import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import common, pii


def test_rules():
    cases = {
        "write a.b+c@mail.example.com now": ["email:6:28"],
        "a@b a@b.c.d": ["email:4:11"],
        "at 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5": ["ip:3:13", "ip:33:40"],
        "card 4111 1111-1111 1111 or 4111111111111112": ["card:5:24"],
        "é +1 (415) 555-0100, +12 34": ["phone:2:19"],
        "4111111111111111 4111111111111111": [],
        "": [],
    }
    for text, want in cases.items():
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.rule_spans(text)] == want, text


def make(rng, n):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = [lambda: f"{word().replace('é', 'e')}.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"+1 ({digits(3)}) 555-{digits(4)}"]
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), rng.choice(kinds)())
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def net():
    return pii.train(make(random.Random(1), 150))


def tagged(net, texts):
    data, offsets = common.flat(pa.array([t.encode() for t in texts], pa.large_binary()))
    own, ends = pii.symbols(data, offsets)
    doc, start, end, tag = pii.runs(pii.network_tags(net, own.astype(np.int64), ends), ends)
    return {(int(d), int(a), int(k) - 1, int(b)) for d, a, b, k in zip(doc, start, end, tag)}


def test_held_out_spans(net):
    texts = make(random.Random(2), 80)
    want = {(i, a, k, b) for i, t in enumerate(texts) for a, k, b in pii.rule_spans(t)}
    assert len(tagged(net, texts) & want) > 0.8 * len(want)


def test_decode_is_the_best_path(net):
    rng = np.random.default_rng(3)
    index = rng.integers(0, 129, (4, 6))
    e, trans = net.emissions(index), net.p["T"]
    got = net.decode(index)
    for n in range(6):
        paths = np.stack(np.meshgrid(*[range(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
        score = sum(e[t, paths[:, t], n] for t in range(4)) + sum(trans[paths[:, t], paths[:, t + 1]] for t in range(3))
        assert np.isclose(score.max(), score[(paths == got[:, n]).all(1)][0], atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    net = pii.Tagger(2)
    index, gold = rng.integers(0, 129, (7, 3)), rng.integers(0, pii.TAGS, (7, 3))
    slopes = net.gradients(index, gold)[1]
    for name in net.p:
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        value, found = net.p[name][at], []
        for e in (3e-3, -3e-3):
            net.p[name][at] = value + e
            found.append(net.gradients(index, gold)[0])
        net.p[name][at] = value
        assert abs((found[0] - found[1]) / 6e-3 - slopes[name][at]) < 0.03 * max(1, abs(slopes[name][at])), name


def test_windows_meet(net):
    text = make(random.Random(5), 1)[0] + " "
    long = text * 40
    alone = tagged(net, [long])
    assert {x for x in tagged(net, ["", long, "x"]) if x[0] == 1} == {(1, a, k, b) for _, a, k, b in alone}
    spans = pii.rule_spans(long)
    assert not spans or len({(0, a, k, b) for a, k, b in spans} & alone) >= 0.6 * len(spans)


def test_table_edges(spark, net):
    rows = [(1, None, "x"), (2, "", "x"), (None, "é me@a.bc", "x"), (3, "+1 (415) 555-0100", "x"), (3, "+1 (415) 555-0100", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.base) for r in pii.find_personal_data(docs, net).collect())
    assert got == [("1", ""), ("2", ""), ("3", "phone:0:17"), ("3", "phone:0:17"), ("None", "email:2:9")]
    assert pii.find_personal_data(docs.limit(0), pii.fitted(docs.limit(0))).count() == 0
