import random
import re

from kpiforge.llm import queries, secrets
from tests.llm.fixtures import SF, documents, edge, empty, python_nodes


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice(["ver", "ing", "the", "schaft", "ment", "tion", "ar", "lo"]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    hexa = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows, planted = [], {}
    for i in range(120):
        t = text()
        if i % 6 == 0:
            planted[i] = hexa()
            t += rng.choice([' token = "%s" ', " api_key: '%s', ", " password=%s "]) % planted[i] + text()
        if i % 5 == 0:
            t += " " + "".join(rng.choice("0123456789") for _ in range(16)) + " " + text()
        rows.append((i, t))
    bare = hexa()
    rows.append((500, text() + " " + bare + " " + text()))
    planted[500] = bare
    return rows, planted


def test_planted_secrets_are_found_and_words_are_not(spark):
    rows, planted = corpus()
    found = secrets.scan(documents(spark, rows)).collect()
    assert {(r.doc_id, r.candidate) for r in found if r.is_secret} == set(planted.items())
    assert sum(not r.is_secret for r in found) > 100         # long words and numbers were candidates


def test_candidates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, m) for r in docs.collect() for m in re.findall("[A-Za-z0-9_+/-]{16,}={0,2}", r.text or ""))
    rows = queries.QUERIES["op7_secret_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.candidate) for r in rows) == want
    assert all(r.is_secret == (r.score >= 0.5) for r in rows)


def test_redaction(spark):
    rows, planted = corpus()
    docs = documents(spark, rows)
    out = secrets.redact(docs, secrets.scan(docs))
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        want = t.replace(planted[i], "[SECRET]") if i in planted else t
        assert got[i].text == want and got[i].n_chars == len(want)


def test_no_python_in_tasks(spark):
    rows, _ = corpus()
    docs = documents(spark, rows)
    assert python_nodes(secrets.candidates(docs)) == []
    assert python_nodes(secrets.redact(docs, secrets.scan(docs))) == []


def test_edges(spark):
    docs = edge(spark)
    assert secrets.redact(docs, secrets.scan(docs)).count() == docs.count()
    assert secrets.scan(empty(spark)).count() == 0
    one = documents(spark, [(None, "token = 0123456789abcdef0123456789abcdef"), (1, None)])
    got = secrets.scan(one).collect()        # labels of one kind only: the label decides
    assert [(r.doc_id, r.is_secret) for r in got] == [(None, True)]
    out = secrets.redact(one, secrets.scan(one)).collect()
    assert sorted((r.text or "") for r in out) == ["", "token = [SECRET]"]


def test_short_and_odd_credentials(spark):
    """Assigned values and url passwords of any characters, by hand."""
    cases = [('password = "Tr0ub4dor&3" end', ["Tr0ub4dor&3"]), ("x pwd=hunter2, y", ["hunter2"]), ("postgres://user:p@ss1!x@db", ["p@ss1!x"]),
             ("go postgres://user:p4ss!x@db/t now", ["p4ss!x"]), ("secret_key: 'a b$c.9%d!'", ["a b$c.9%d!"]), ("Authorization: Bearer ab.c1!d", ["ab.c1!d"]),
             ('{"api_key": "k.9$x!", "n": 1}', ["k.9$x!"]), ('password = "q\\"4x!z" z', ['q\\"4x!z']), ("token = abc", []), ("a password is nice", []),
             ("password=0123456789abcdef0", ["0123456789abcdef0"]), ("my password = \"x1!y2", ["x1!y2"])]
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(cases)])
    got = {}
    for r in secrets.candidates(docs).collect():
        got.setdefault(r.doc_id, []).append(r.candidate)
        before = cases[r.doc_id][0].split(r.candidate)[0]
        assert r.word_no == len(re.findall("[ \t-\r]+", before)) and r.start == len(before)
    assert [got.get(i, []) for i in range(len(cases))] == [c for _, c in cases]


def test_planted_short_credentials_are_redacted(spark):
    rng = random.Random(8)
    rows, planted = corpus()
    odd = ["Tr0ub4dor&3", "hunter2"] + ["".join(rng.choice("bcdfgkqxz0123456789!$%&.") for _ in range(rng.randint(6, 12))) + "7q!x" for _ in range(40)]
    for k, v in enumerate(odd):
        rows.append((1000 + k, f"{rows[k][1]} " + ['password = "%s" x', "pwd=%s y", "secret: '%s' z", "go http://me:%s@host/x z"][k % 4] % v))
    out = {r.doc_id: r.text for r in secrets.redact(documents(spark, rows), secrets.scan(documents(spark, rows))).collect()}
    assert not [v for k, v in enumerate(odd) if v in out[1000 + k]]


def test_redaction_cuts_where_the_secret_stands(spark):
    """Not inside other words, and only in the row that has it."""
    from pyspark.sql import functions as F

    texts = ["password = cat5 ... cat5e cable runs to bobcat500 and cat5", 'k = "test1" # see test10 and latest12', "ümlaut😀 pwd=cat5! end", "key key-0123456789abcdef0123, key-0123456789abcdef01234"]
    docs = documents(spark, [(1, t) for t in texts])
    every = secrets.candidates(docs).withColumn("is_secret", F.lit(True))
    got = sorted(r.text for r in secrets.redact(docs, every).collect())
    assert got == sorted(["password = [SECRET] ... cat5e cable runs to bobcat500 and cat5", texts[1], "ümlaut😀 pwd=[SECRET] end", "key [SECRET], [SECRET]"])
    # Overlapping candidates leave one mark.
    both = documents(spark, [(1, "token=\"0123456789abcdef01 x\" y")])
    found = secrets.candidates(both).withColumn("is_secret", F.lit(True))
    assert found.count() == 2 and [r.text for r in secrets.redact(both, found).collect()] == ['token="[SECRET]" y']


def test_no_limits_around_an_assignment(spark):
    cases = ["token" + "x" * 45 + " = Zz9!q8", "password" + " " * 20 + "=" + " " * 30 + "Zz9!q8", "a" * 60 + "://me:Zz9!q8@host/"]
    got = secrets.candidates(documents(spark, [(i, t) for i, t in enumerate(cases)])).filter("candidate = 'Zz9!q8'").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2]
