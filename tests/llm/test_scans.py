import hashlib
import random
import re
import time

import pytest

from attestor.llm import pii, secrets

_word = "".join
SECRET_RULES = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PII_RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for k, d in enumerate(digits(m)[::-1])) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
]
PIECES = ["password", "PassWord", "token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc123", "deadbeef" * 3, "AKIA" + "A1" * 9, "AKIA", "\n", "ſecret", "toKen", "4111 1111 1111 1111", "+", "+1 (555) 123-4567", "1.2.3.4", ".", "@", "a.b", "x@y.com", "-", "256", "9", "_", "%", "é", "😀", "IBAN DE89370400440532013000", "account no: 123456789", "5500005555555559", "://u:p@h.com", "0" * 30]


def brute(text, rules):
    order = [k for k, _, _ in rules]
    return sorted(((k, m.start(), m.end()) for k, r, ok in rules for m in r.finditer(text) if ok(m)), key=lambda x: (x[1], order.index(x[0])))


def texts(n):
    rng = random.Random(7)
    return [_word(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_base_spans_equal_the_rules():
    anchors = pii.automaton()
    for text in texts(4000):
        assert [s for s in secrets.scan(text) if s[0] in secrets.KINDS[:3]] == brute(text, SECRET_RULES), text
        assert [s for s in pii.scan(text, anchors) if s[0] in pii.KINDS[:4]] == brute(text, PII_RULES), text


@pytest.mark.parametrize(
    "text, value",
    [
        ('db_pwd = "Xk29sLq0PzT"', "Xk29sLq0PzT"),
        ("{'clientCredential': 'q8Zr71LmPw0x'}", "q8Zr71LmPw0x"),
        ('credential := "ab12" + "Cd34ef"', 'ab12" + "Cd34ef'),
        ('k = "a8Fzkq02ZZp1"\naccess_key = k', "a8Fzkq02ZZp1"),
        ("export AUTH_KEY=Zk81hsPq02LmnB", "Zk81hsPq02LmnB"),
        ('pwd: str = r"Xk29sLq0PzT"', "Xk29sLq0PzT"),
        ("passphrase = '''Xk29sLq0PzT'''", "Xk29sLq0PzT"),
        ('auth_key = ("Zk81hsPq" "02LmnB")' .replace("(", "").replace(")", ""), 'Zk81hsPq" "02LmnB'),
        ('head = "Zk81hsPq"\nauth_key = head + "02LmnB"', "Zk81hsPq"),
        ("def f():\n    x = 'nothing at all'\nx = 'Zk81hsPq02LmnB'\ndef g():\n    credential = x", "Zk81hsPq02LmnB"),
        ("# it's a comment\n<property name='dbPwd' value: 'Zk81hsPq02LmnB', authKey: 'Yk81hsPq02LmnB'>", "Yk81hsPq02LmnB"),
        ("passphrase='Zk81hs\\'Pq02LmnB'", "Zk81hs\\'Pq02LmnB"),
    ],
)
def test_lexer_finds_literals(text, value):
    assert value in [text[s:e] for k, s, e in secrets.scan(text) if k in ("literal", "constant")]


def test_constants_end_with_their_scope():
    text = "def f():\n    k = 'Zk81hsPq02LmnB'\ndef g():\n    access_key = k"
    assert [s for s in secrets.scan(text) if s[0] == "constant"] == []
    text = "k = 'Zk81hsPq02LmnB'\ndef f():\n    k = 'short'\naccess_key = k"
    assert [text[s:e] for k, s, e in secrets.scan(text) if k == "constant"] == ["Zk81hsPq02LmnB"]


@pytest.mark.parametrize("piece", ["password = 'Zk81hsPq02LmnB'\n", "k = k + k\nsecret_key = k\n", "key='", "'\\'", '"""', "a=b=c=", "key: ", "pwd['a'] = x + y + ", "key = 'a' 'b' + "])
def test_long_texts_take_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        secrets.scan("k = 'ab'\n" + piece * (n // len(piece)))
        return time.process_time() - start

    seconds(10_000)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.02)


@pytest.mark.parametrize(
    "text, value",
    [
        ("api_secret_phrase => Zk81hsPq02LmnB", "Zk81hsPq02LmnB"),
    ],
)
def test_lexer_reads_bare_words(text, value):
    assert value in [text[s:e] for k, s, e in secrets.scan(text)]


@pytest.mark.parametrize("text", ["title: The pass over the mountain", 'private_key = "changeme"', "auth = ${SECRET_FROM_ENV}", "see http://host/path?x=1", "key: value"])
def test_lexer_leaves_plain_text(text):
    assert [s for s in secrets.scan(text) if s[0] in ("literal", "constant")] == []


def test_redaction():
    text = "a password=abcdef1 and " + "0123456789abcdef" * 2 + " z"
    assert secrets.redact(text, secrets.scan(text)) == "a [SECRET] and [SECRET] z"


def test_extra_personal_data():
    anchors = pii.automaton()
    text = "IBAN: DE89 3704 0044 0532 0130 00, account number 12345678, https://me:pw@host.org/x, IBAN DE00370400440532013000"
    assert [(k, text[s:e]) for k, s, e in pii.scan(text, anchors) if k in pii.KINDS[4:]] == [("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("login_url", "me:pw")]


def test_frames(spark):
    long = "x " * 200_000 + "password=abcdef1 1.2.3.4"
    rows = [(1, None, 0), (2, "", 0), (None, "token: abcdefg", 0), (3, long, 1), (3, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    found = secrets.secret_scan(df).collect()
    assert len(found) == 5
    by = {r.doc_id: r for r in found}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1].base_sha256 == by[2].base_sha256 == empty and by[1].spans == ""
    assert by[None].n_assign == 1 and by[3].spans == "assign:400000:400016"
    assert {r.doc_id: r.n_ip for r in pii.pii_scan(df).collect()} == {1: 0, 2: 0, None: 0, 3: 1}
    assert secrets.secret_scan(df.where("false")).count() == pii.pii_scan(df.where("false")).count() == 0
    clean = secrets.without_secrets(df)
    assert clean.columns == df.columns and clean.where("text like '%abcdef%'").count() == 0 and clean.where("text is null").count() == 1
