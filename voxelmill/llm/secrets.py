"""Secret scans: candidates from text, and a random forest that removes the false positives.

Candidates are tokens of at least MIN_TOKEN characters that are no plain word (they have a digit, or an upper-case letter
somewhere after a lower-case one), values assigned to a name that speaks of credentials, tokens with the beginning of a published
format, passwords in URLs, and private key blocks; none has a greatest length. Features: length, shares and transitions of character
classes, entropy, dictionary coverage, form (hexadecimal, UUID, known prefixes), the path, and the neighbouring words. The forest is
trained from labelled findings: a table (before, candidate, after, path, label) of the caller's, or, as the tables here have none,
``sample_findings``, which makes labelled findings from formats of secrets and of their look-alikes (hashes, UUIDs, numbers,
versions, names, placeholders).

Edge cases: null and empty texts have no candidates; a null path has no path features; a null doc_id stays null; repeated
rows give repeated findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import read_table
from voxelmill.llm.forest import Forest, train

MIN_TOKEN, MIN_VALUE, AROUND = 12, 6, 48
#: Labelled findings that a forest learns from at most.
MAX_FINDINGS = 20_000
_TOKENS = re.compile(r"[A-Za-z0-9_+/=\-.~]+")
_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
_OPEN, _STOP = re.compile(r"([=:]{1,2})>?[ \t]{0,3}[\"'`]?"), re.compile(r"[\s\"'`,;<>]")
#: A whole name before = or :, of any length; it begins where a run begins and is not tried again within it, so the search is linear.
_NAME = re.compile(r"(?<![\w.\-])([\w.\-]++)[\"'`]?[ \t]{0,3}+(?=[=:])")
_CREDENTIAL = re.compile(r"(?i)passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|key")
_PEM = re.compile(r"-----(BEGIN|END) [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_SCHEME = re.compile(r"[\w+.\-]*(?=://)")
_URL = re.compile(r"://[^\s/?#:@\"<>`]*:([^\s/?#\"<>`]+)@")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_HEX, _WORD = re.compile(r"[0-9a-fA-F]+$"), re.compile(r"[a-z]+")
_VERSION = re.compile(r"v?\d+(\.\d+)+([-+.]\w+)*$")

# Beginnings of published credential formats.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "SG.", "npm_", "hf_", "-----BEGIN")
_PREFIXED = re.compile("(?<![A-Za-z0-9_])(" + "|".join(re.escape(p) for p in PREFIXES if p != "-----BEGIN") + r")[A-Za-z0-9_+/\-.~]+(?:={1,2}(?![\w\"']))?")
# Words that stand beside secrets, beside look-alikes, and in paths.
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api", "key", "access", "auth", "credential", "credentials", "bearer", "private", "login")
OTHER_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "hash", "checksum", "digest", "uuid", "guid", "id", "version", "image", "base64", "isbn", "order", "card", "phone", "tel", "build", "revision", "etag", "integrity")
FAKE_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "xxxx", "test", "fake", "redacted", "todo", "foo", "bar", "none", "null")
PATH_WORDS = (("test", "spec", "fixture", "mock"), ("example", "sample", "doc", "readme"), ("lock", ".min.", "dist", "vendor", "node_modules"), (".env", "config", "secret", "credential", ".pem", ".yml", ".yaml", ".properties"))
# A short dictionary of frequent words.
DICTIONARY = frozenset(
    "about access account action admin after backup base board body book build button cache call change check class client close cloud code color column comment common config content control count create data database date default delete demo device document domain download edit email enable engine error event example export fail field file filter find first form format function game global header hello home icon image import index info input item java key label language last level like line link list live load local login manager member memory menu message method mode model module name network news node number object option order page panel password path people phone photo power price private process product profile program project public query queue release report request result root sample search secret section select send server service session set setting simple source state static status store string style submit support system table task team test text theme title token update upload user value version video window word world".split()
)


@dataclass(frozen=True)
class Finding:
    before: str
    candidate: str
    after: str
    path: str
    label: int = 0


def _mixed(text: str, a: int, b: int) -> bool:
    """A digit, or an upper-case letter after a lower-case one: what no plain word has."""
    return bool(_DIGIT.search(text, a, b)) or bool((low := _LOWER.search(text, a, b)) and _UPPER.search(text, low.end(), b))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, in order, none inside another; every search is linear in the text."""
    spans: dict[int, int] = {}
    begin = None
    for m in _PEM.finditer(text):
        if m.group(1) == "BEGIN":
            begin = m.start()
        elif begin is not None:
            spans[begin], begin = m.end(), None
    for m in _PREFIXED.finditer(text):
        b = m.end()
        while text[b - 1] in ".-":
            b -= 1
        if b > m.end(1):
            spans[m.start()] = max(b, spans.get(m.start(), 0))
    urls = set()  # a value that is a URL with a password gives way to the password
    for m in _URL.finditer(text):
        urls.add(m.start())
        spans[m.start(1)] = max(m.end(1), spans.get(m.start(1), 0))
    for m in _TOKENS.finditer(text):
        a, b = m.span()
        if b - a < MIN_TOKEN or not _mixed(text, a, b):
            continue
        # an assignment's name is no part of the token, padding of base64 is
        eq = text.find("=", a, b - 2)
        while eq >= 0 and eq + 1 < b and text[eq + 1] not in "=":
            a, eq = eq + 1, text.find("=", eq + 1, b - 2)
        while b > a and text[b - 1] in ".-":
            b -= 1
        if b - a >= MIN_TOKEN and _mixed(text, a, b):
            spans[a] = max(b, spans.get(a, 0))
    stop = 0  # values of one run end where it does, so each run's end is looked for once
    for m in _NAME.finditer(text):
        if not _CREDENTIAL.search(text, m.start(1), m.end(1)):
            continue
        o = _OPEN.match(text, m.end())
        for a in [o.end()] + ([m.end() + 1] if len(o.group(1)) == 2 else []):  # a second sign may belong to the value
            if a >= stop:
                stop = end.start() if (end := _STOP.search(text, a)) else len(text)
            if stop - a >= MIN_VALUE:
                if not ((u := _SCHEME.match(text, a)) and u.end() in urls):
                    spans[a] = max(stop, spans.get(a, 0))
                break
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans.items(), key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _coverage(s: str) -> float:
    """Share of characters in dictionary words of four letters or more, longest first from the left."""
    low, covered = s.lower(), 0
    for m in _WORD.finditer(low):
        run, k = m.group(), 0
        while k < len(run):
            hit = next((n for n in range(min(12, len(run) - k), 3, -1) if run[k : k + n] in DICTIONARY), 0)
            covered, k = covered + hit, k + max(1, hit)
    return covered / max(1, len(s))


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def features(f: Finding) -> list[float]:
    s, n = f.candidate, max(1, len(f.candidate))
    kinds = [_kind(c) for c in s]
    share = Counter(kinds)
    moves = Counter((a, b) for a, b in zip(kinds, kinds[1:], strict=False) if a != b)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(s).values())
    letters = [c for c in s.lower() if "a" <= c <= "z"]
    vowels = sum(c in "aeiou" for c in letters) / max(1, len(letters))
    run = max((len(m.group()) for m in re.finditer(r"[A-Za-z]+", s)), default=0)
    before, after = f.before.lower(), f.after.lower()
    words = re.findall(r"[a-z_0-9]+", before)[-4:] + re.findall(r"[a-z_0-9]+", after)[:2]
    near = lambda group: float(any(w in group or any(part in group for part in w.split("_")) for w in words))
    low, path = s.lower(), f.path.lower()
    return [
        float(n), share[2] / n, share[1] / n, share[0] / n, share[3] / n, entropy, entropy / max(1.0, math.log2(n)),
        sum(moves.values()) / n, (moves[0, 2] + moves[2, 0]) / n, (moves[0, 1] + moves[1, 0]) / n, (moves[1, 2] + moves[2, 1]) / n,
        _coverage(s), vowels, run / n, max(Counter(s).values(), default=0) / n,
        float(bool(_HEX.match(s))), float(bool(_UUID.match(s))), float(s.isdigit()), float(bool(_VERSION.match(s))), float(s.startswith(PREFIXES)),
        float(any(w in low for w in FAKE_WORDS)), float("/" in s or "." in s),
        near(SECRET_WORDS), near(OTHER_WORDS), near(FAKE_WORDS), float(bool(re.search(r"[=:][ \t]*[\"'`]?$", f.before))), float("@" in f.before[-24:] or f.after.startswith("@")), float("://" in f.before[-40:]),
        *[float(any(w in path for w in group)) for group in PATH_WORDS],
    ]


def sample_findings(n: int = 6000, seed: int = 17) -> list[Finding]:
    """Labelled findings made from formats of secrets and of what is mistaken for them."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    vocabulary = sorted(DICTIONARY)
    prose = lambda k: " ".join(rng.choice([*vocabulary, pick(string.ascii_lowercase, rng.randint(2, 9))]) for _ in range(k))
    names = ("password", "passwd", "db_password", "secret", "client_secret", "token", "auth_token", "api_key", "apikey", "access_key", "AWS_SECRET_ACCESS_KEY", "private_key")
    give = lambda: f"{rng.choice(names)}{rng.choice(['=', ' = ', ': ', '=' + chr(34), ' = ' + chr(34), ': ' + chr(39)])}"
    url = lambda: rng.choice(["https", "http", "postgres", "mysql", "redis", "amqp", "ftp"]) + "://" + rng.choice(["", rng.choice(vocabulary), pick(string.ascii_lowercase, 5)]) + ":"
    host = lambda: "@" + rng.choice(["localhost", rng.choice(vocabulary) + ".com", "10.0.0." + pick("123456789", 1)]) + "/"
    secret = (
        lambda: (rng.choice(["", give(), "the ", prose(1) + " "]), "AKIA" + pick(upper, 16)),
        lambda: (rng.choice(["", give(), prose(1) + " "]), rng.choice(["ghp_", "gho_", "npm_", "hf_"]) + pick(alnum, 36)),
        lambda: (rng.choice(["", give()]), rng.choice(["sk_live_", "rk_live_"]) + pick(alnum, 24)),
        lambda: (rng.choice(["", give()]), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)),
        lambda: (rng.choice(["", give()]), "AIza" + pick(alnum + "_-", 35)),
        lambda: (rng.choice(["Bearer ", give(), ""]), "eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum + "_-", 43)),
        lambda: (give(), pick(alnum + "+/", 40)),
        lambda: (rng.choice([give(), give(), prose(1) + " "]), pick(string.ascii_letters, rng.choice([16, 20, 24, 32, 40]))),
        lambda: (give(), pick(string.ascii_lowercase, rng.randint(12, 32))),
        lambda: (give(), pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (give(), pick(alnum + "!#$%&*", rng.randint(8, 20))),
        lambda: (give(), rng.choice(vocabulary).capitalize() + pick(string.digits, rng.randint(2, 5)) + rng.choice("!#$%*") + pick(alnum, 3)),
        lambda: (url(), rng.choice([pick(string.ascii_lowercase, rng.randint(4, 7)) + pick(string.digits, rng.randint(1, 3)), pick(alnum + "!$%*-_", rng.randint(8, 20)), rng.choice(vocabulary) + pick(string.digits, rng.randint(1, 4))]), host()),
        lambda: ("", "-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n" + pick(alnum + "+/", rng.choice([400, 3000])) + "\n-----END PGP PRIVATE KEY BLOCK-----"),
        lambda: ("", "-----BEGIN PRIVATE KEY-----\n" + pick(alnum + "+/", 400) + "\n-----END PRIVATE KEY-----"),
    )
    other = (
        lambda: (rng.choice(["commit ", "sha1: ", "SHA256=", "md5:", "checksum ", "digest: ", "revision ", "integrity=", "hash "]), pick(hexa, rng.choice([32, 40, 64]))),
        lambda: (rng.choice(["id: ", "uuid=", "guid ", "", "request "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (rng.choice(["card ", "", "order ", "id=", prose(1) + " "]), pick(string.digits, rng.choice([12, 13, 15, 16, 19]))),
        lambda: (rng.choice(["", "tel ", "phone: ", prose(1) + " "]), "-".join(pick(string.digits, k) for k in (3, 3, 3, 4))),
        lambda: (rng.choice(["version ", "v", "==", "build "]), ".".join(pick(string.digits, rng.randint(1, 4)) for _ in range(rng.randint(3, 6)))),
        lambda: (rng.choice(["", "class ", "import "]), "".join(rng.choice(vocabulary).capitalize() for _ in range(3)) + pick(string.digits, rng.randint(1, 3))),
        lambda: (rng.choice(["", "class ", "import ", "the ", prose(1) + " "]), rng.choice(["", "get", "is", "on", "my"]) + "".join(rng.choice(vocabulary).capitalize() for _ in range(rng.randint(2, 4)))),
        lambda: (rng.choice(["", "in ", "/"]), rng.choice("/.").join("".join(rng.choice(vocabulary).capitalize() for _ in range(rng.randint(1, 2))) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randint(2, 4)))),
        lambda: (rng.choice(["", prose(1) + " "]), pick(string.ascii_lowercase, rng.randint(4, 9)) + rng.choice(["-", ".", "_", "."]) + pick(string.ascii_lowercase, rng.randint(3, 9)).capitalize()),
        lambda: (rng.choice(["", "see ", "/"]), "/".join(rng.choice(vocabulary) for _ in range(3)) + pick(string.digits, 2) + ".html"),
        lambda: (give(), rng.choice(["your_api_key_here", "xxxxxxxxxxxx", "changeme123", "example-token-1234", "<placeholder12>", "dummy_secret_0000", "test_password_1", "REDACTED0000"])),
        lambda: (give(), rng.choice(["os.environ", "process.env.", "config.", "settings.", "get_"]) + "_".join(rng.choice(vocabulary) for _ in range(2)) + rng.choice(["", "1"])),
        lambda: (rng.choice(["data:image/png;base64,", "base64 image "]), pick(alnum + "+/", rng.randint(40, 90))),
        lambda: (rng.choice(["", "on ", "date "]), f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}"),
        lambda: (rng.choice(["", "mail ", prose(1) + " "]), pick(string.ascii_lowercase, 8) + "." + pick(string.digits, 2) + "-" + rng.choice(vocabulary)),
        lambda: (rng.choice([prose(1) + " ", ""]), "_".join(rng.choice(vocabulary) for _ in range(3)) + "_" + pick(string.digits, 2)),
        lambda: (rng.choice(["http://", "https://"]), rng.choice(vocabulary) + pick(string.digits, 2) + ".example.com/" + rng.choice(vocabulary)),
        lambda: (rng.choice(["", prose(1) + " ", "import "]), rng.choice(["npm_", "hf_", "SG.", "gho_", "eyJ"]) + rng.choice("_.").join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3)))),
        lambda: (url(), rng.choice(["password", "your_password", "xxxx", "changeme", "example", "<password>", "test", "placeholder"]), host()),
        lambda: (rng.choice(["token ", "key ", "the token ", "auth: "]), rng.choice(["expires_in_3600", "required2024", "authentication2", "management_v2x"])),
    )
    out = []
    for k in range(n):
        label = k % 2
        before, candidate, *at = rng.choice(secret if label else other)()
        path = rng.choice(["", "src", f"src{rng.randint(0, 9)}", "app/main.py", "README.md", "tests/test_api.py", "package-lock.json", ".env", "config.yml"])
        quote = '"' if before.endswith('"') else "'" if before.endswith("'") else ""
        out.append(Finding((prose(3) + " " + before)[-AROUND:], candidate, (quote + "".join(at) + rng.choice([" ", "\n", ", ", ""]) + prose(2))[:AROUND], path, label))
    return out


def fit(findings: list[Finding]) -> Forest:
    """A forest from labelled findings, MAX_FINDINGS at most."""
    if len(findings) > MAX_FINDINGS:
        raise ValueError(f"{len(findings)} findings; sample them to {MAX_FINDINGS}")
    return train(np.array([features(f) for f in findings]), np.array([f.label for f in findings], float))


def fit_table(findings: DataFrame) -> Forest:
    """As fit, from a table (before, candidate, after, path, label); a hash sample of it if it is larger."""
    rows = findings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "candidate", "after", "path")], F.col("label").cast("int")).where("label IS NOT NULL")
    share = MAX_FINDINGS * 0.95 / max(1, rows.count())
    draw = F.pmod(F.xxhash64("before", "candidate", "after"), F.lit(1 << 30)) / float(1 << 30)
    kept = rows.where(draw < share) if share < 1 else rows
    return fit([Finding(*r) for r in sorted(map(tuple, kept.limit(MAX_FINDINGS).collect()))])


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, secret, score, is_secret): every candidate with its score; spans in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(path, F.lit("")).alias("path"))
    names = ["doc_id", "start", "end", "secret", "score", "is_secret"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for doc_id, text, where in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                for a, b in candidates(text or ""):
                    at.append((doc_id, a, b))
                    found.append(Finding(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND], where))
            score = sent.value.predict(np.array([features(f) for f in found])) if found else np.zeros(0)
            cols = list(zip(*at, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array([f.candidate for f in found], pa.string()), pa.array(score), pa.array(score >= threshold)], names)

    return rows.mapInArrow(run, "doc_id long, start long, end long, secret string, score double, is_secret boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), fit(sample_findings()))  # documents have no paths: source names a crawl
    return found.select("doc_id", "start", "end", F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score"), "is_secret")
