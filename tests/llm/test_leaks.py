"""Secret scan: base patterns against a scan by hand, and name-literal pairs of many syntaxes."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from atriumq.llm import leaks

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def by_hand(t):
    """Base spans without regular expressions: leftmost, longest run of the last class, failing matches eaten."""
    out, i = [], 0
    value = set(string.ascii_letters + string.digits + "+/_.=-")

    def assign(i):
        for n in NAMES:
            word = t[i : i + len(n)]
            if len(word) == len(n) and word.isascii() and word.lower() == n:
                j = i + len(n)
                j += t[j : j + 1] in ("'", '"') and j < len(t)
                while t[j : j + 1] == " ":
                    j += 1
                if t[j : j + 1] not in ("=", ":") or j >= len(t):
                    continue
                j += 1
                while t[j : j + 1] == " ":
                    j += 1
                j += j < len(t) and t[j] in "'\""
                k = j
                while k < len(t) and t[k] in value:
                    k += 1
                if k > j:
                    return j, k
        return None

    while i < len(t):
        found = assign(i)
        if found is None:
            i += 1
            continue
        j, k = found
        if k - j >= 6:
            out.append(("assign", i, k))
        i = k
    i = 0
    while i < len(t):
        if t.startswith("AKIA", i) and t[i + 4 : i + 5] in set(string.ascii_uppercase + string.digits):
            k = i + 4
            while k < len(t) and t[k] in set(string.ascii_uppercase + string.digits):
                k += 1
            if k - i >= 20:
                out.append(("access", i, k))
            i = k
        else:
            i += 1
    i = 0
    while i < len(t):
        k = i
        while k < len(t) and t[k] in "0123456789abcdef":
            k += 1
        if k - i >= 24:
            out.append(("hex", i, k))
        i = max(k, i + 1)
    return sorted(out, key=lambda s: (s[1], leaks.KINDS.index(s[0])))


def base(t):
    return [s[:3] for s in leaks.spans_of(t) if s[0] != "literal"]


def test_base_against_hand_scan():
    rng = random.Random(3)
    bits = [*NAMES, "API_KEY", "Token", "PassWord", "ſecret", "toKen", "=", ":", "==", " ", "  ", '"', "'", "\n", "abc123", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "deadbeef", "é", "_", ".", "-", "x", "😀"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert base(t) == by_hand(t), t


@pytest.mark.parametrize(
    "text, found",
    [
        ('db_pwd = "hunter22x"', ["hunter22x"]),
        ('DB_PASS = "p@ss:w0rd!"', ["p@ss:w0rd!"]),
        ('a = "s3cr3t-"\nb = "Tail99"\nconn.passphrase = a + b', ["s3cr3t-", "Tail99"]),
        ('auth_key = part\npart = "late-Value1"', ["late-Value1"]),
        ('x = "old-Value1"\nx = "new-Value2"\nsigning_key = x', ["new-Value2"]),
        ("x = y\ny = x\nauth_key = x", []),
        ('config["private_key"] = \'MIIEvQIBADANBg\'', ["MIIEvQIBADANBg"]),
        ('{"aws": {"secretKey": "wJalrXUtnFEMI/K7MDENG"}}', ["wJalrXUtnFEMI/K7MDENG"]),
        ("signing_key: 9f8e7d6c5b  # why", ["9f8e7d6c5b"]),
        ('props.setProperty("db.pwd", "Zx9!kk88");', ["Zx9!kk88"]),
        ('#define MASTER_KEY "0xDEADBEEF77"', ["0xDEADBEEF77"]),
        ("<credential>abC123xyz</credential>", ["abC123xyz"]),
        ('let pwd: string = "Quoted77value";', ["Quoted77value"]),
        ("export DB_PWD=abcd1234efgh", ["abcd1234efgh"]),
        ("pwd=${OTHER}\nOTHER=zz-Late-11", ["zz-Late-11"]),
        ("Pass: Khyber", []),
        ("The pin: a thing of beauty that's a joy for ever", []),
        ('pwd = "changeme"', []),
        ('token_path = "/etc/abc123/x"', []),
        ('pwd_min_length = "abcdef12"', []),
        ('greeting = "hello-World1"', []),
        ('credential = "two words 12"', []),
        ('pwd = "short"', []),
    ],
)
def test_pairs(text, found):
    assert [text[a:b] for k, a, b, _ in leaks.spans_of(text) if k == "literal"] == found


def test_literals_that_a_pattern_covers_are_not_repeated():
    assert [s[0] for s in leaks.spans_of('password = "abcdef123"\nx = "abcdef124"')] == ["assign"]


def test_long_texts_take_linear_time():
    for bad in ("a=b=" * 60_000 + " token", "'token " * 60_000, '"""token ' * 40_000, "<a>token" * 40_000, "token = " + "a + " * 60_000, "pwd: " * 60_000, "_" * 300_000 + "token="):
        leaks.spans_of(bad)
    long = "words and words " * 40_000 + '\ndb_pwd = "hunter22x"\n'
    assert [long[a:b] for _, a, b, _ in leaks.spans_of(long)] == ["hunter22x"]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdef"), (3, "token=abcdef"), (None, 'é😀 db_pwd = "hunter22x"')]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("t", "spans", "kind", "start", "end", "score")})
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in leaks.secret_scan(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [("assign", 0, 12)]), (3, [("assign", 0, 12)]), (None, [("literal", 13, 22)])], key=str)
    assert leaks.secret_scan(df.where("doc_id > 9")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = leaks.op12_secret_scan(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        want = by_hand(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r.spans.split(",")) | {""}
