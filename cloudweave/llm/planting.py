"""Labelled findings for the secret scan: secrets and look-alikes of many kinds, planted in the corpus's own texts.

A label is the kind's, so it does not follow from what a classifier sees: keys stand with and without a name,
stand-ins of the same length and alphabet are assigned to the same names, and the words and the path around a
value are those of the document, unless the kind has telling ones.
"""

from __future__ import annotations

import random
import string
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common

#: Documents that findings are planted in at most (those of least hash), characters of each, findings of a kind at least.
SAMPLE, AROUND, LEAST = 500, 2000, 400

# Names, stand-ins, telling words, prefixes of keys and paths.
NAMES = ("token", "secret", "password", "passwd", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "auth_token", "secret_key", "TOKEN", "API_KEY", "Password")
STAND_INS = ("changeme", "your-token-here", "your_password", "insert-your-key", "replace_me_123", "REDACTED", "none", "null", "undefined", "true", "required", "optional", "<password>", "<your-api-key>", "${PASSWORD}", "$API_KEY", "{{ secret }}", "%(token)s", "TODO", "test1234", "password123", "string", "not-a-real-key-0001")
REFERENCES = ("os.environ", "self.token", "config.password", "get_token(user_id)", "request.headers.token", "settings.SECRET_KEY", "vault.read(path)", "process.env.API_KEY", "args.auth_token", "load_key(name1)")
TELLING = ("deploy with", "login by", "our key is", "sign in using", "use the key", "authorize with", "credentials", "the access code is", "connect by")
DIGESTS = ("commit", "checksum", "sha1", "sha256", "md5", "digest", "fingerprint", "revision", "etag", "build", "object id", "blob")
NUMBERS = ("order", "part", "model", "flight", "invoice", "serial number", "ticket", "version", "card", "phone", "build number", "the date")
PREFIXES = ("ghp_", "gho_", "sk_live_", "rk_live_", "xoxb-", "glpat-", "npm_", "hf_", "SG.")
TEST_PATHS = ("tests/fixtures", "docs/examples", "src/test/mock", "samples/basic", "example/notes")
CODE_PATHS = ("src/main/config", "deploy/settings", "app/env", "infra/values")
MARKS = "!#$%&*+-.:=?@^_~"

ALNUM = string.ascii_letters + string.digits
Draw = random.Random
#: label, words before, value, quoted by, path (None: the document's, or one of code).
Finding = tuple[float, str, str, str, str | None]


def _of(r: Draw, letters: str, low: int, high: int) -> str:
    return "".join(r.choices(letters, k=r.randint(low, high)))


def _hex(r: Draw) -> str:
    return "".join(r.choices("0123456789abcdef", k=r.choice((32, 40, 40, 64))))


def _password(r: Draw) -> str:
    """A digit or more, a mark or more, and letters, some beyond ASCII."""
    part = [*r.choices(string.digits, k=r.randint(1, 3)), *r.choices(MARKS, k=r.randint(1, 2)), *r.choices(ALNUM + "äöüßéñ", k=r.randint(1, 9))]
    return r.choice(ALNUM) + "".join(r.sample(part, len(part))) + r.choice(ALNUM + "$")


def _word_password(r: Draw, words: list[str]) -> str:
    """A word, or halves of two, as it is or respelt; digits, a mark or two, perhaps letters; in this or any order."""
    one, two = r.choices(words, k=2)
    word = r.choice((one, one[: len(one) // 2 + 1] + two[len(two) // 2 :]))[: r.randint(3, 9)]
    word = r.choice((word, word, word.capitalize(), word.replace("o", "0").replace("e", "3").replace("a", "4"), word.replace("o", "ö").replace("s", "ß")))
    part = [word, _of(r, string.digits, 1, 3), _of(r, MARKS, 1, 2), _of(r, string.digits, 0, 2), _of(r, ALNUM, 0, 2)]
    return "".join(r.choice((part, r.sample(part, len(part)))))


def _jwt(r: Draw) -> str:
    return "eyJ" + ".".join(_of(r, ALNUM + "-_", 8, 60) for _ in range(3))


def _key(r: Draw) -> str:
    """A random key of some alphabet, as it is assigned to a name."""
    return r.choice((_hex, _hex, lambda r: _of(r, ALNUM, 16, 48), lambda r: _of(r, ALNUM + "+/", 20, 60) + "=", _jwt))(r)


def _named(r: Draw, label: float, value: str, path: str | None = None, lead: str = "") -> Finding:
    """An assignment to a name; without quotes where the value allows."""
    quote = r.choice(("\"", "\"", "'", ""))
    if quote in value or " " in value:
        quote = "\""
    sign = r.choice((" = ", "=", ": ", " := ")) if quote else r.choice((" = ", "=", ": "))
    return label, lead + r.choice(NAMES) + sign, value, quote, path


def _block(r: Draw) -> Finding:
    kind = r.choice(("RSA ", "EC ", "OPENSSH ", ""))
    body = "\n".join(_of(r, ALNUM + "+/", 64, 64) for _ in range(r.randint(2, 20)))
    return 1.0, "", f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", "", None


def _flat(r: Draw) -> str:
    """As long as a key and of its alphabet, but repeated or counted up."""
    unit = r.choice((r.choice("0123456789abcdefx"), "deadbeef", "0123456789abcdef", "abc123", "1234567890", _of(r, "0123456789abcdef", 2, 4)))
    return (unit * 64)[: r.choice((16, 32, 40, 64))]


def _number(r: Draw) -> str:
    d = lambda low, high: _of(r, string.digits, low, high)
    return r.choice((lambda: d(12, 20), lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: f"{r.randrange(1990, 2040)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", lambda: f"{d(3, 3)}-{d(4, 4)}", lambda: f"v{d(1, 2)}.{d(1, 2)}.{d(2, 4)}", lambda: f"{d(4, 4)}-{d(4, 4)}-{d(4, 4)}-{d(4, 4)}"))()


def _uuid(r: Draw) -> str:
    return "-".join(_of(r, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))


def _identifier(r: Draw, words: list[str]) -> str:
    some = r.choices(words, k=r.randint(2, 4))
    return r.choice((lambda: "".join(some), lambda: "".join(some).capitalize(), lambda: "".join(some).upper(), lambda: "_".join(some) + "_2", lambda: "".join(w.capitalize() for w in some), lambda: "/".join(some) + "/v1.txt", lambda: "-".join(some) + "-01"))()


def _address(r: Draw, words: list[str]) -> str:
    a, b, c = r.choices(words, k=3)
    return r.choice((f"{a}.{r.randrange(100)}@mail{r.randrange(10)}.{b}.com", f"https://www.{a}{b}.com/{c}/{r.randrange(1000)}", f"{a}@{b}{r.randrange(10)}.org"))


#: What makes a finding from a draw and words of the document, by kind.
KINDS: dict[str, Callable[[Draw, list[str]], Finding]] = {
    "named hex": lambda r, w: _named(r, 1.0, _hex(r)),
    "named key": lambda r, w: _named(r, 1.0, _key(r)),
    "named password": lambda r, w: _named(r, 1.0, _password(r)),
    "named word password": lambda r, w: _named(r, 1.0, _word_password(r, w)),
    "bearer": lambda r, w: (1.0, r.choice(("Authorization: Bearer ", "bearer ", "Bearer: ")), r.choice((_jwt, _key))(r), "", None),
    "key block": lambda r, w: _block(r),
    "cloud key": lambda r, w: (1.0, r.choice(("", "", *TELLING)) + " ", r.choice(("AKIA", "ASIA")) + _of(r, string.ascii_uppercase + string.digits, 16, 16), "", None),
    "prefixed key": lambda r, w: (1.0, r.choice(("", "", *TELLING)) + " ", r.choice(PREFIXES) + _of(r, ALNUM, 20, 40), r.choice(("", "\"")), None),
    "told key": lambda r, w: (1.0, r.choice(TELLING) + " ", _of(r, ALNUM, 18, 44), r.choice(("", "\"", "'")), None),
    "plain key": lambda r, w: (1.0, "", _of(r, ALNUM, 24, 48), r.choice(("", "\"")), None),
    "told token": lambda r, w: (1.0, "", _jwt(r), "", None),
    "key in address": lambda r, w: (1.0, "", f"{r.choice(('postgres', 'https', 'amqp', 'mysql'))}://{r.choice(w)}:{_of(r, ALNUM, 12, 24)}@{r.choice(w)}.internal:{r.randrange(1000, 9999)}", "", None),
    "named stand-in": lambda r, w: _named(r, 0.0, r.choice(STAND_INS)),
    "named reference": lambda r, w: (0.0, r.choice(NAMES) + r.choice((" = ", "=", ": ")), r.choice(REFERENCES), "", None),
    "named flat value": lambda r, w: _named(r, 0.0, _flat(r)),
    "named word": lambda r, w: _named(r, 0.0, r.choice(w)),
    "key of a test": lambda r, w: _named(r, 0.0, _key(r), r.choice(TEST_PATHS)),
    "key of an example": lambda r, w: _named(r, 0.0, _key(r), r.choice((None, *TEST_PATHS)), r.choice(("example ", "dummy ", "sample ", "placeholder "))),
    "digest": lambda r, w: (0.0, r.choice(DIGESTS) + r.choice((" ", ": ", "=", " of file ")), _hex(r), r.choice(("", "\"")), None),
    "plain digest": lambda r, w: (0.0, "", r.choice((_hex, _uuid))(r), r.choice(("", "\"")), None),
    "number": lambda r, w: (0.0, r.choice(("", *NUMBERS)) + " ", _number(r), "", None),
    "code": lambda r, w: (0.0, r.choice(NUMBERS) + " ", _of(r, string.ascii_uppercase, 2, 4) + r.choice(("", "-")) + _of(r, string.digits, 5, 9), "", None),
    "identifier": lambda r, w: (0.0, "", _identifier(r, w), r.choice(("", "\"")), None),
    "address": lambda r, w: (0.0, "", _address(r, w), "", None),
}


def planted(table: DataFrame, sample: int = SAMPLE, around: int = AROUND, least: int = LEAST) -> DataFrame:
    """row_key, doc_id, path, text, start, length, label, kind: a short text for each planted finding.

    table (row_key, path, text): the sample rows of least hash that have text are planted in, around characters from
    a place that their hash gives. Every kind comes about least times, and at least once a row. Repeated rows
    count once; an empty table, or one without texts, gives none.
    """
    size = F.char_length("text")
    place = F.pmod(F.xxhash64("row_key", F.lit("place")), F.greatest(F.lit(1), size - around)).cast("int") + 1
    texts = table.where(size > 0)
    # At most sample keys, so they go with the tasks; only their rows are gathered.
    keys = texts.select("row_key").distinct().orderBy(F.xxhash64("row_key"), "row_key").limit(sample)
    texts = texts.join(F.broadcast(keys), "row_key", "left_semi").groupBy("row_key")
    some = common.materialize(texts.agg(F.min("path").alias("path"), F.min(F.substring("text", place, F.lit(around))).alias("text")))
    rounds = -(-least // max(1, some.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                plain = [w for w in words if w.isalpha() and w.isascii()] or ["word", "name", "value"]
                for kind, make in KINDS.items():
                    for k in range(rounds):
                        r = random.Random(zlib.crc32(f"{key} {kind} {k}".encode()))
                        label, lead, value, quote, other = make(r, plain)
                        at = r.randrange(len(words)) if words else 0
                        before = " ".join([*words[max(0, at - 6) : at], lead.lstrip()]) + quote
                        new = f"{before}{value}{quote} " + " ".join(words[at : at + 4])
                        other = other or (path if r.random() < 0.7 else r.choice(CODE_PATHS))
                        rows.append((r.getrandbits(62), 0, other, new, len(before), len(value), label, kind))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["row_key", "doc_id", "path", "text", "start", "length", "label", "kind"]
    return some.repartition(8, "row_key").mapInArrow(run, "row_key long, doc_id long, path string, text string, start long, length long, label double, kind string")
