"""Nested secrets: base spans against a plain scan, nested encodings by round trips, places, cycles and bombs."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import urllib.parse
import zlib

import pytest
import zstandard

from foldwise.llm import nested_secrets as N

KEY = "AKIA" + "Q7" * 9


def plain_base(text):
    """The base kinds by walking along the text, without regular expressions."""
    out = []
    low = "".join(c.lower() if c.isascii() else c for c in text)

    def some(at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    k = 0
    while k < len(text):
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(word, k):
                at = k + len(word)
                at += text[at:at + 1] in ('"', "'") and at < len(text)
                at = some(at, " ")
                if text[at:at + 1] not in (":", "=") or at >= len(text):
                    continue
                at = some(at + 1, " ")
                at += text[at:at + 1] in ('"', "'") and at < len(text)
                end = some(at, value)
                if end == at:
                    continue
                if end - at >= 6:
                    out.append((k, "assign", end))
                k = end - 1
                break
        k += 1
    k = 0
    while (k := text.find("AKIA", k)) >= 0:
        end = some(k + 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        if end - k >= 20:
            out.append((k, "access", end))
        k = end if end > k + 4 else k + 1
    k = 0
    while k < len(text):
        end = some(k, "0123456789abcdef")
        if end - k >= 24:
            out.append((k, "hex", end))
        k = max(end, k + 1)
    return sorted(out, key=lambda r: (r[0], N.KINDS.index(r[1]), r[2]))


def base(text):
    return [(s, k, e) for s, k, e, p in N.secrets(text) if p == ""]


TRICKY = [
    "", "password=token:abcdef", "token=abc", "token==abcdef", "API_KEY : 'abcdef'", "apikey=\"x\" secret= y secretsecret=abcdefg", "ſecret=abcdefg toKen=abcdefg",
    "AKIAAKIA" + "A" * 12, "AKIA", "AKIAAKIA", "x" * 5 + "0123456789abcdef" * 3, "password\"=  'a.b-c_d/e", "password = token", "tokentoken: aaaaaaa", "Passwd:" + "z" * 9000,
    "password=\nabcdefg", "secret\t=abcdefg", "password='", "token:'\"abcdefgh", "é" * 30 + " token=ééé secret=ab_cd.ef",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert base(text) == plain_base(text)


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    parts = ["password", "passwd", "SECRET", "token", "api", "_", "key", "=", ":", " ", "'", '"', "abc", "AKIA", "0af9", "QRS7", "deadbeef", "é", "\n", "-/+", "aa11"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert base(text) == plain_base(text), text


WRAPS = {
    "url": lambda b: "".join(f"%{x:02X}" for x in b),
    "url-some": lambda b: urllib.parse.quote(b.decode(), safe=""),
    "unicode": lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode()),
    "refs": lambda b: "".join(f"&#{ord(c)};" for c in b.decode()),
    "bytes": lambda b: "".join(f"\\x{x:02x}" for x in b),
    "base64": lambda b: base64.b64encode(b).decode(),
    "base64url": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    "mime": lambda b: base64.encodebytes(b).decode().rstrip("\n"),
    "utf16": lambda b: base64.b64encode(b.decode().encode("utf-16-le")).decode(),
    "gzip": lambda b: base64.b64encode(gzip.compress(b)).decode(),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)).decode(),
    "bz2": lambda b: base64.b64encode(bz2.compress(b)).decode(),
    "xz": lambda b: base64.b64encode(lzma.compress(b)).decode(),
    "zstd": lambda b: base64.b64encode(zstandard.ZstdCompressor().compress(b)).decode(),
    "twice": lambda b: base64.b64encode(gzip.compress(zlib.compress(b))).decode(),
    "url-gzip": lambda b: "".join(f"%{x:02x}" for x in gzip.compress(b)),
    "bytes-zlib": lambda b: "".join(f"\\x{x:02x}" for x in zlib.compress(b)),
}


@pytest.mark.parametrize("name", WRAPS)
def test_one_wrap(name):
    inner = f"some words before, then {KEY} and after"
    coded = WRAPS[name](inner.encode())
    text = f"Préambule — {coded} fin."
    found = [f for f in N.secrets(text) if f[1] == "access"]
    assert len(found) == 1 and bool(found[0][3]) == (KEY not in coded)
    s, _, e, _ = found[0]
    a = text.index(coded)
    assert a <= s < e <= a + len(coded)


def test_places_are_exact():
    text = "go to x?password%3Dhunt%65r22&y"
    assert ("password%3Dhunt%65r22" in {text[s:e] for s, k, e, p in N.secrets(text) if p == "url"})
    text = "ab\\u0074oken\\u003d\\u0022abcdef9 z"
    assert text.index("\\u0074") in {s for s, k, e, p in N.secrets(text) if p == "unicode" and k == "assign" and text[s:e].endswith("abcdef9")}
    inner = "x" * 7 + KEY + "yy"
    coded = base64.b64encode(inner.encode()).decode()
    text = f"v: {coded};"
    (s, k, e, p), = [f for f in N.secrets(text) if f[3]]
    at = text.index(coded)
    # the group of the first and of the last byte of the key
    assert (k, p, s, e) == ("access", "base64", at + 8 * 7 // 6, at + (8 * (7 + len(KEY)) - 1) // 6 + 1)
    text = "ｐａｓｓｗｏｒｄ＝ｈｕｎｔｅｒ２２"
    assert [(s, k, e) for s, k, e, p in N.secrets(text) if p == "unicode"] == [(0, "assign", len(text))]


def test_random_nests_are_found():
    rng = random.Random(11)
    plain = [n for n in WRAPS if n not in ("url-some",)]
    for _ in range(150):
        inner = f"{rng.choice(['a', 'note:', ''])} api_key={hashlib.sha1(str(rng.random()).encode()).hexdigest()[:16]}zz{rng.choice(['', ' tail', ';'])}"
        coded, names = inner, []
        for _ in range(rng.randint(1, 4)):
            names.append(rng.choice(plain))
            coded = WRAPS[names[-1]](coded.encode())
        text = f"Lorem {coded} ipsum dolor"
        found = [f for f in N.secrets(text) if f[1] == "assign" and f[3]]
        at = text.index(coded)
        assert found and all(at <= s < e <= at + len(coded) for s, _, e, _ in found), names


def test_context_around_escapes_and_copies():
    text = "token%20=%20%27abcdef123%27 and token%20=%20%27abcdef123%27"
    assert [text[s:e] for s, k, e, p in N.secrets(text) if p] == ["token%20=%20%27abcdef123"] * 2
    coded = base64.b64encode(f"key {KEY}".encode()).decode()
    text = f"{coded} {coded}\n{coded}"
    assert len({s for s, k, e, p in N.secrets(text) if k == "access"}) == 3


def test_ordinary_text_has_no_layers():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    assert N.secrets(" ".join(words) + " 100% sure \\upper &#x; %zz %u12 " + "A" * 400 + "=" * 5) == []
    assert [k for _, k, _, _ in N.secrets(hashlib.sha256(b"1").hexdigest())] == ["hex"]


def test_cycles_end_and_bombs_are_reported():
    bomb = base64.b64encode(gzip.compress(b"\0" * (3 << 20))).decode()
    got = N.secrets(f"see {bomb} end", most=1 << 20)
    assert [(s, k, e) for s, k, e, _ in got] == [(4, "oversize", 4 + len(bomb.rstrip("=")))]
    nest = "%25" * 300 + "41"
    assert N.secrets(nest) == []
    text = "token=" + "%2561" * 50
    assert any(p == "url>url" and text[s:e] == text for s, k, e, p in N.secrets(text))
    fixed = "%E4%zz\\ud800 &#55296; &#1114112; \\u{110000}"
    assert N.secrets(fixed) == []


def test_documents(spark):
    coded = base64.b64encode(f"x {KEY} x".encode()).decode()
    rows = [(1, None), (2, ""), (3, f"hello {coded}."), (3, f"hello {coded}."), (None, "secret: 'abcdefgh' " + "w " * 300_000), (5, "clean é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS secrets", "1 AS found", "2 AS c0", "map('a', 1) AS path")
    got = N.scan(df, into="hits").collect()
    assert [r["secrets"] for r in got] == ["x"] * 6 and got[0].asDict()["found"] == 1
    by = {(r["doc_id"], (r["text"] or "")[:3]): [tuple(f) for f in r["hits"]] for r in got}
    assert by[1, ""] == by[2, ""] == by[5, "cle"] == []
    assert [f[1] for f in by[3, "hel"]] == ["access"] and by[None, "sec"] == [(0, "assign", 17, "")]
    clean = {r["doc_id"]: r["text"] for r in N.redact(df).collect()}
    assert KEY not in clean[3] and clean[3].startswith("hello ") and clean[1] is None and clean[None].startswith("[SECRET]' w")
    assert N.scan(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from foldwise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_secret_layers"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_base(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in want) for n in ("assign", "access", "hex")]
        assert set(listed.split(",")) <= set(r["spans"].split(",")) or not want
