"""Base spans against plain regular expressions; estimation and added spans on known data."""

import hashlib
import random
import re

from tallyscope.llm import pii as P


def plain(text):
    """Base spans as the contract states them."""
    text = text or ""
    out = []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def expected(text):
    spans = plain(text)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    return tuple(sum(k == x for k, _, _ in spans) for x in P.BASE) + (digest,)


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, candidates string")
    return {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in P.find(df).collect()}


CASES = [
    None, "", "no data", "a@b.c", "x.y+z@m-1.example.com, a@b.c_d@e.f a@b.c..x@y.z @a.b a@b a@b.", "é\U0001f600 und.34@mail7.example.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 1..2.3.4 9.9.9.9x", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112",
    "4111 1111  1111 1111 4111 1111 1111 1111 1", "+1 (017) 555-7713 +123 +1 2 3 4 5 6 7 8 9 +44 (0) 20.7946.0958- +12345678901234567",
    "7536784127813050 4845168114407329", "+1 555 4845168114407329 8.8.8.8", "0" * 5000, "1 2 3 4 " * 3000, "a.b" * 4000 + "@x" + ".y" * 4000,
    " a@b.co  8.8.8.8", "x" * 30000 + "@example.org", "line\na@b.de\r\n+49 30 123456 78\t10.0.0.1",
]


def test_base_spans_are_those_of_the_contract(spark):
    rng = random.Random(7)
    bits = ["1", "22", "333", "4111111111111111", " ", "-", ".", "+", "@", "a", "b.c", "(", ")", "x@y.z", "é", "\n", "0"]
    texts = CASES + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(600)]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i][:5] == expected(t), repr(t)[:200]
        listed = [tuple(s.split(":")) for s in got[i][5].split(",") if s]
        want = [(k, str(a), str(b)) for k, a, b in plain(t)]
        assert [x for x in listed if x in want] == want
        assert [P.KINDS.index(k) for k, _, _ in listed] == sorted(P.KINDS.index(k) for k, _, _ in listed)


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "a@b.com")] * 3, "doc_id long, text string")
    assert [r.n_email for r in P.find(df).collect()] == [1, 1, 1]


def test_added_spans(spark):
    texts = ['the token = "9742a250774262d69ad6a86100194ed53da5a0ef" here', "Contact: Dr. Anna Schmidt, tel (212) 555-0199.", "a@b.com +1 (301) 555-0346 10.1.2.3"] * 30
    texts += ["password: aaaaaaaaaaaaaaaa", "plain words only"]
    got = run(spark, texts)
    assert got[0][5] == "secret:13:53"
    assert "phone_local:" in got[1][5] and "person:13:25" in got[1][5]


def test_estimation_ranks_labelers():
    """Patterns made by labelers of known reliability."""
    rng = random.Random(1)
    rates = {"valid": 0.95, "gazetteer": 0.9, "context": 0.75, "shape": 0.85, "edges": 0.6}
    counts, truth = {}, {}
    for _ in range(20000):
        y = rng.random() < 0.6
        votes = tuple((1 if y else -1) * (1 if rng.random() < rates[x] else -1) for x in P.LABELERS)
        counts[votes] = counts.get(votes, 0) + 1
        truth[votes] = truth.get(votes, 0) + y
    rows = [{"kind": "secret", "length": 1, "n": n, **dict(zip(P.LABELERS, v))} for v, n in sorted(counts.items())]
    found, agree = P.estimate(rows)
    for x in P.LABELERS:
        assert abs(agree[x] - rates[x]) < 0.04
    assert sum(r["n"] * abs(t - truth[tuple(r[x] for x in P.LABELERS)] / r["n"]) for r, t in zip(rows, found)) / 20000 < 0.06


def test_redaction_keeps_everything_else(spark):
    df = spark.createDataFrame([(1, "write a@b.com or 8.8.8.8!", "en"), (2, None, "de"), (3, "clean  text", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in P.redact(df).collect()}
    assert got == {1: ("write <EMAIL> or <IP>!", "en"), 2: (None, "de"), 3: ("clean  text", "fr")}


def test_many_matches_in_one_text(spark):
    from tallyscope.llm import pii

    n = 6000
    text = " ".join(f"user{i}@mail{i % 97}.com" for i in range(n)) + "\n" + "x" * 9000 + " mail me: a@b.org"
    df = spark.createDataFrame([(1, text, "kept", {"a": 1})], "doc_id bigint, text string, __text string, __candidates map<string,int>")
    row = pii.find(df).first()
    spans = [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("email")]
    assert row.n_email == n + 1 and [text[a:b] for a, b in spans][-1] == "a@b.org"
    assert [text[a:b] for a, b in spans[:n]] == text.split("\n")[0].split(" ")
    out = pii.redact(df).first()
    assert out.text == " ".join(["<EMAIL>"] * n) + "\n" + "x" * 9000 + " mail me: <EMAIL>"
    assert (out["__text"], out["__candidates"]) == ("kept", {"a": 1})


def test_running_values_in_two_levels(spark):
    from pyspark.sql import functions as F

    from tallyscope.llm.pii import running

    df = spark.createDataFrame([([(i * 7) % 31 for i in range(n)],) for n in (0, 1, 63, 64, 65, 1000)], "v array<int>")
    for r in df.select("v", running(F.col("v"), "int", lambda x, y: x + y).alias("s"), running(F.col("v"), "int", lambda x, y: F.greatest(x, y)).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max([0, *r.v[:i]]) for i in range(len(r.v))]


def test_counted_patterns_and_their_plan(spark):
    texts = [None, "", "nothing here", "mail a.b@example.com or x@example.org", "call +49 30 123456 now", "mail a.b@example.com or x@example.org"]
    found = P.with_candidates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "text")
    counted = P.patterns(found)
    votes = {}
    for r in found.collect():
        for c in r.candidates:
            key = tuple(c[k] for k in ["kind", *P.LABELERS, "length"])
            votes[key] = votes.get(key, 0) + 1
    assert votes and {tuple(r)[:-1]: r.n for r in counted.collect()} == votes
    # the driver holds, writes and compiles the patterns no more often than to find the candidates
    sizes = [d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") for d in (found, counted)]
    assert 0 < sizes[1] <= sizes[0]
