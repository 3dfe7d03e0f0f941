"""Secret scans: fixed patterns against a matcher written out by hand, lexing against planted assignments."""

from __future__ import annotations

import hashlib
import random
import string
import time

import pytest

from faultloom.llm.secret_scan import LITERAL, Reader, base_spans, literal_score, name_score, scan, secret_spans, secrets
from tests.llm.test_llm import ODD, documents

VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
SECRET = "q8Zr2LmT9xVw"


def lower(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


def assign_at(text, at):
    """End of the match at ``at`` and length of its value, or None: each optional part tried with and without."""
    for name in NAMES:
        if lower(text[at : at + len(name)]) != name:
            continue
        p = at + len(name)
        for quoted in ((1, 0) if text[p : p + 1] in ("'", '"') else (0,)):
            q = p + quoted
            while text[q : q + 1] == " ":
                q += 1
            if text[q : q + 1] not in (":", "="):
                continue
            q += 1
            while text[q : q + 1] == " ":
                q += 1
            if text[q : q + 1] in ("'", '"'):
                q += 1
            end = q
            while end < len(text) and text[end] in VALUE:
                end += 1
            if end > q:
                return end, end - q
    return None


def brute_base(text):
    out = []
    at = 0
    while at < len(text):
        found = assign_at(text, at)
        if found and found[1] >= 8:
            out.append((at, found[0], 0))
        at = found[0] if found else at + 1
    for number, first, rest, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 16), (2, "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            end = at + len(first)
            if text.startswith(first, at):
                while end < len(text) and text[end] in rest:
                    end += 1
            if end <= at + len(first) and not (first and text.startswith(first, at) and end > at + len(first)):
                at += 1
                continue
            if end - at >= least:
                out.append((at, end, number))
            at = end
    return sorted(out, key=lambda s: (s[0], s[2]))


def noisy(seed, n):
    rnd = random.Random(seed)
    bits = list(NAMES) + ["PassWord", "TOKEN", "ſecret", "toKen", "AKIA", "AKIAAKIA"] + list("\"'  ::==\n.é日")
    bits += ["abc", "deadbeef" * 4, "0123456789abcdef", "ABCDEFGH1234", "x_y/z+", "AAAAAAAAAAAA", "g"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_fixed_patterns_equal_a_matcher_by_hand():
    for text in noisy(1, 4000):
        assert sorted(base_spans(text), key=lambda s: (s[0], s[2])) == brute_base(text), text


PLANTED = {
    f'db_pwd = "{SECRET}"': 1,
    f'"clientSecret" : "{SECRET}",': 1,
    f"config['db_password'] = '{SECRET}'": 1,
    f"export PGPASSWORD={SECRET}": 1,
    f"pwd: {SECRET}": 1,
    f'#define AUTH_TOKEN "{SECRET}"': 1,
    f"<password>{SECRET}</password>": 1,
    f"mysql --password {SECRET} -u root": 1,
    f'const apiKey string = "{SECRET}"': 1,
    f'access_token: str = os.getenv("T", "{SECRET}")': 1,
    f':secret_key => "{SECRET}"': 1,
    f'final char PASSWORD[] = "{SECRET}"': 1,
    f"session_key = `{SECRET}`": 1,
    f'KEY = "{SECRET}"\nx = 1\npassphrase = KEY': 1,
    f'passphrase = KEY\nKEY = "{SECRET}"': 1,
    f'a = b = "{SECRET}"\ncreds = a': 1,
    f'P="{SECRET}"\nDB_PASSWORD="${{P}}"': 1,
    f'A = "{SECRET[:6]}"\nB = "{SECRET[6:]}"\nself.auth_token = A + B\n': 2,
    f'password = ("{SECRET[:5]}"\n   "{SECRET[5:]}")': 2,
    f'token = "{SECRET[:4]}" + \\\n  "{SECRET[4:]}"': 2,
}
CLEAN = [
    'password_file = "/etc/secret/a.txt"',
    'token_type = "Bearer123x"',
    "password = get_password()",
    'password: "changeme123"',
    "The token: something else, the secret = everything",
    "don't tell; key: it's fine",
    'pass = "${SECRET}"',
    f'x = "{SECRET}"',
    "a = b\nb = a\ntoken = a",
    'KEY = "harmless"\nKEY = other\nlabel = KEY',
    'password = "aaaaaaaaaaaaaaaa"',
    "",
]


@pytest.mark.parametrize("text", PLANTED)
def test_planted_assignments(text):
    prose = "Ein Satz: vorher, o'clock.\n"
    found = Reader(prose + text + "\nand after = all").secrets()
    assert "".join((prose + text)[s:e] for s, e, *_ in sorted(found)) == SECRET and len(found) == PLANTED[text]
    assert all(name_score(name) > 0 and score >= 0.5 for *_, name, score in found)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_assignments(text):
    assert Reader("Some words. " + text + "\n").secrets() == []


def test_constants_are_taken_from_the_last_assignment_before():
    text = f'K = "{SECRET}"\ntoken = K\nK = "another-1-value"\n'
    assert [text[s:e] for s, e, *_ in Reader(text).secrets()] == [SECRET]


def test_scores():
    assert [name_score(n) for n in ("dbPassword", "API_KEY", "apiToken", "sessionKey", "tokenCount", "tokenizer", "monkey", "")] == [1, 1, 1, 0.6, 0, 0, 0, 0]
    assert literal_score("short1", True) == 0 == literal_score("two words here", True) == literal_score("https://host/path", True)
    assert literal_score(SECRET, False) == 1 and literal_score("something", False) == 0 < literal_score("something", True)


def test_query_columns_on_odd_rows(spark):
    texts = list(PLANTED) + CLEAN + noisy(2, 60) + ["x" * 200_000 + f' token = "{SECRET}"']
    rows = list(enumerate(texts)) + ODD + [(3, texts[0])] * 30
    got = secrets(documents(spark, rows))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = ("assign", "access", "hex")

    def expected(key, text):
        base = brute_base(text or "")
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in base)
        lexed = {(s, e) for s, e, *_ in Reader(text or "").secrets()}
        spans = [(s, k, e) for s, e, k in base] + [(s, 3, e) for s, e in lexed]
        listed = ",".join(f"{(*kinds, LITERAL)[k]}:{s}:{e}" for s, k, e in sorted(spans))
        return (key, *(sum(k == n for *_, k in base) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest(), listed)

    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert secrets(documents(spark, ODD).limit(0)).count() == 0
    [row] = secret_spans(documents(spark, [(1, f'db_pwd = "{SECRET}"')])).collect()
    assert [tuple(s) for s in row.spans] == [(LITERAL, 10, 22, "db_pwd", 1.0)]


N = 60_000
LONG = {
    "one_word": "a" * N,
    "joined": "token=" + '"ab"+' * N + '"c"',
    "plus": "x=a+" * N,
    "dots": "x=a." * N,
    "calls": "x=f(" * N,
    "open_quotes": 'x="\n' * N,
    "chain": "".join(f"a{i}=a{i + 1}\n" for i in range(N)) + f'a{N}="{SECRET}"\ntoken=a0',
    "cycle": "".join(f"a{i}=a{i + 1}+a{i // 2}\n" for i in range(N)) + "token=a0",
    "spaces": "x" + " " * N + "y" + "(" * N,
    "nested": "token=" * N + SECRET,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(name):
    start = time.time()
    scan(LONG[name])
    assert time.time() - start < 10
