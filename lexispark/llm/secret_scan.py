"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more characters of keys and tokens with both a letter and a digit; values that are assigned
to a credential's name, in quotes or up to white space, of any length; passwords in addresses; keys with a provider's
prefix; and private keys in PEM, to the end mark or, without one before the next block, as far as lines look like
theirs. A text is gone through once for each form: names are looked at where they begin, a value ends before the next
is looked for, and a block before the next begins, so time grows with the text whatever it holds.

The forest has the verdict on all of them. Its features are which forms found the value; the length and the kinds of
characters, and whether they are what passwords or placeholders have; how likely the transitions between characters are
in words of a public vocabulary, and how much of the value such words cover; the document's path, its parts hashed; and
the words beside the value, hashed by place.

It is trained on labelled findings: rows (value, before, after, path, label). Where none are given, `weak_findings`
labels a bounded sample of the corpus's own candidates: one assigned to a credential's name is a secret; one after a
word for digests or in an address is not; others have no label. Made from each: random values of several alphabets and
short passwords after names of credentials are secrets, and so are keys of providers, passwords in addresses and PEM
blocks; the same values after words for digests, or beside plain words, and identifiers, dictionary words and
placeholders wherever they stand, are not.

What none of these forms has is never masked: secrets in free text that are shorter than 16 characters or have no
digit, without a known prefix; and names that NAME doesn't list.

The forest is fitted by Spark's ML library on at most `sample` findings, made-up ones included; candidates are scored
where the documents are read, without a shuffle. Null texts have no candidates, null paths count as empty; repeated
documents are scanned row by row; ranges are in characters, and secrets that overlap are one. An empty table gives no
rows. Texts of any length are scanned whole. Columns of docs may have any names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_transducer import read_ranks
from .common import bounded_batches
from .packing import release

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.\-]{16,}")
#: Names of credentials; a name at its start, up to what is assigned to it; a value without quotes; keys known by their
#: provider's prefix; marks and lines of private keys in PEM.
NAME = re.compile(r"(?i)token|secret|passw(?:or)?d|passwd|pwd|passphrase|api.?key|access.?key|private.?key|credential")
ASSIGNMENT = re.compile(r"(?<![\w.-])([\w.-]++)[\"'`]?[ \t]*+(?::=|=>|[=:])[ \t]*+")
SPACED_KEY = re.compile(r"(?i)(?:api|access|private) \Z")
BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]]++")
PROVIDER = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[\w-]{20,}+|xox[abeoprs]-[\w-]{10,}+|AIza[\w-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}+\.[\w-]{16,}+)(?![A-Za-z0-9])")
BEGIN, PEM = "-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
PEM_LINES = re.compile(r"(?:\s++(?:[A-Za-z-]++: [^\n]*+|[A-Za-z0-9+/=]{16,}+))*+")
ADDRESSED = re.compile(r"(?<=://)[^\s:/@\"'<>]++:([^\s:/@\"'<>]++)@(?=[\w.\[-])")
PASSWORD = re.compile(r"(?=[^\s]*[A-Za-z])(?=[^\s]*[0-9])(?=[^\s]*[!@#$%^&*~])[^\s${%<(][^\s]*+")
FORMS = ("pem", "provider", "assigned", "addressed", "run")
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
BEFORE, AFTER, SAMPLE, CUTOFF = 48, 16, 4000, 0.5
#: No more findings than these are made from one.
MADE = 100
CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|api.?key|access.?key|private.?key|credential|bearer|auth)\w*\W{0,4}$")
DIGEST = re.compile(r"(?i)(?:commit|sha\d*|md5|checksum|digest|hash|uuid|etag|revision|integrity)\W{0,4}$")
ADDRESS = re.compile(r"(?i)(?:https?:|www\.|@)\S*$")
PLACEHOLDER = re.compile(r"(?i)example|sample|placeholder|changeme|your|xxx|000000|123456|abcdef")
#: Bins of hashed words before and after a value, and of parts of a path.
BEFORE_BINS, AFTER_BINS, PATH_BINS = 64, 8, 16
#: Names that made-up findings stand after.
CREDENTIALS = ["token", "password", "api_key", "secret", "passwd", "API_KEY", "access_key", "client_secret", "auth_token", "private_key", "credential", "Authorization: Bearer", "DB_PASSWORD", "secretKey"]
DIGESTS = ["commit", "sha256:", "checksum", "md5 =", "revision:", "digest =", "hash", "etag:", "build", "uuid =", "object", "blob"]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def covered(value: str, words: frozenset[str], longest: int) -> float:
    """The share of a value that dictionary words cover, longest first from the left."""
    text, at, n = value.lower(), 0, 0
    while at < len(text):
        for size in range(min(longest, len(text) - at), 3, -1):
            if text[at : at + size] in words:
                n += size
                at += size
                break
        else:
            at += 1
    return n / len(text)


class Vocabulary:
    """Words of four letters or more of a public vocabulary, and how likely characters follow each other in them."""

    def __init__(self, words: frozenset[str]):
        self.words, self.longest = words, max(map(len, words))
        pairs, firsts = Counter(x for w in words for x in zip(w, w[1:])), Counter(c for w in words for c in w[:-1])
        self.log = {x: math.log((n + 0.5) / (firsts[x[0]] + 14)) for x, n in pairs.items()}
        self.unseen = {c: math.log(0.5 / (n + 14)) for c, n in firsts.items()}

    def likelihood(self, value: str) -> float:
        """Mean logarithm over the transitions; digits and signs follow anything with 1 in 40."""
        text = value.lower()
        each = [self.log.get(x, self.unseen.get(x[0], -3.7) if x[1].isalpha() else -3.7) for x in zip(text, text[1:])]
        return sum(each) / max(1, len(each))


def _bin(word: str, bins: int) -> int:
    return zlib.crc32(word.encode()) % bins


def features(value: str, before: str, after: str, path: str, forms: frozenset[str], vocabulary: Vocabulary) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = [value.count(c) for c in set(value)]
    letters = max(map(len, re.findall("[A-Za-z]+", value)), default=0)
    run = max(len(m.group()) for m in re.finditer(r"(.)\1*", value, re.S))
    near, far, parts = [0.0] * BEFORE_BINS, [0.0] * AFTER_BINS, [0.0] * PATH_BINS
    for i, word in enumerate(re.findall(r"[a-z]+", before.lower())[:-4:-1]):
        at = _bin(word, BEFORE_BINS)
        near[at] = max(near[at], 1 / (1 + i))
    for word in re.findall(r"[a-z]+", after.lower())[:1]:
        far[_bin(word, AFTER_BINS)] = 1.0
    for part in re.findall(r"[a-z]+", path.lower()):
        parts[_bin(part, PATH_BINS)] = 1.0
    return [
        *(float(f in forms) for f in FORMS), float(bool(PASSWORD.fullmatch(value))), float(bool(PLACEHOLDER.search(value))), float(value.strip("{}$<>%").isalpha()),
        float(n), -sum(c / n * math.log2(c / n) for c in counts), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(c in "aeiouAEIOU" for c in value) / n, letters / n, float(not value.strip("0123456789abcdefABCDEF")),
        len(counts) / n, run / n, covered(value, vocabulary.words, vocabulary.longest), vocabulary.likelihood(value), float(path.count("/")),
        float(bool(re.search(r"[=:]\W{0,2}$", before))), float(before[-1:] in ('"', "'", "`")), float(after[:1] in ('"', "'", "`")), *near, *far, *parts,
    ]


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to credentials' names, one after the other."""
    at = 0
    while m := ASSIGNMENT.search(text, at):
        at = m.end()
        if not (NAME.search(m[1]) or m[1][:3].lower() == "key" and SPACED_KEY.search(text, max(0, m.start() - 8), m.start())):
            continue
        if (quote := text[at : at + 1]) in ("'", '"', "`"):
            end = text.find(quote, at + 1)
            if end > at + 1 and "\n" not in text[at + 1 : end]:
                yield at + 1, end
                at = end + 1
        elif value := BARE.match(text, at):
            yield value.span()
            at = value.end()


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys in PEM."""
    for m in PEM.finditer(text):
        limit = text.find(BEGIN, m.end())
        end = PEM_END.search(text, m.end(), limit if limit >= 0 else len(text)) or PEM_LINES.match(text, m.end())
        yield m.start(), end.end()


def candidates(text: str) -> list[tuple[int, int, frozenset[str]]]:
    """Ranges in order, and the forms that found them. Nothing else starts or ends in a PEM block or a key by prefix; runs
    may lie in assigned values."""
    found: dict[tuple[int, int], set[str]] = {}
    for form, spans in (("pem", _blocks(text)), ("provider", (m.span() for m in PROVIDER.finditer(text)))):
        for span in spans:
            found.setdefault(span, set()).add(form)
    whole = sorted(found)

    def apart(a: int, b: int) -> bool:
        i = bisect.bisect_left(whole, (a, a))
        return (a, b) in found or not (i and whole[i - 1][1] > a or i < len(whole) and whole[i][0] < b)

    runs = []
    for m in CANDIDATE.finditer(text):
        end = m.start() + len(m.group().rstrip(".-=") if m.group()[-1] in ".-" else m.group())
        if end - m.start() >= 16 and re.search("[0-9]", text[m.start() : end]) and re.search("[A-Za-z]", text[m.start() : end]):
            runs.append((m.start(), end))
    for form, spans in (("assigned", _assigned(text)), ("addressed", (m.span(1) for m in ADDRESSED.finditer(text))), ("run", runs)):
        for span in spans:
            if apart(*span):
                found.setdefault(span, set()).add(form)
    return [(a, b, frozenset(forms)) for (a, b), forms in sorted(found.items())]


def forms_of(value: str, before: str, after: str) -> frozenset[str]:
    """The forms that find a value between what stands beside it."""
    a = len(before)
    return next((f for x, y, f in candidates(before + value + after) if (x, y) == (a, a + len(value))), frozenset())


@lru_cache(maxsize=1)
def dictionary(ranks_path: str) -> Vocabulary:
    """The letter tokens of four characters or more of a public vocabulary, lower-cased."""
    return Vocabulary(frozenset(t.strip().decode().lower() for t in read_ranks(ranks_path) if t.strip().isalpha() and t.isascii() and len(t.strip()) > 3))


def _found(docs: DataFrame, text: str, path: str) -> DataFrame:
    """value, before, after and path of every candidate."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t[a:b], t[max(0, a - BEFORE) : a], t[b : b + AFTER], p) for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, _ in candidates(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["value", "before", "after", "path"])

    return docs.select(F.coalesce(text, F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")).mapInArrow(find, "value string, before string, after string, path string")


def _varied(value: str, before: str, after: str, path: str, words: list[str]) -> Iterator[tuple]:
    """Labelled findings made from one candidate; what varies comes from its own digest."""
    draw = hashlib.sha256(value.encode()).digest()
    if PLACEHOLDER.search(value) or DIGEST.search(before) or ADDRESS.search(before):
        yield value, before, after, path, 0
    elif CREDENTIAL.search(before):
        yield value, before, after, path, 1
    rng = random.Random(draw)
    word = lambda: rng.choice(words)
    some = lambda alphabet, least, most: "".join(rng.choices(alphabet, k=rng.randint(least, most)))
    digest, quote = rng.choice(DIGESTS), rng.choice(['"', "'", ""])
    named = lambda: f"{rng.choice([before[-20:], word()])} {rng.choice(['', word() + '_', word()[:6].upper() + '_'])}{rng.choice(CREDENTIALS)}{rng.choice(['=', ' = ', ': ', chr(34) + ': ', ' => '])}{quote}"
    plain = lambda: f"{word()} {word()} {rng.choice(['', '= ', ': ', '/', '('])}{rng.choice(['', quote])}"
    after = lambda first: first + rng.choice(["", "\n", f" {word()}", f", {word()}", f" {word()} {word()}"])
    keys = [some(LETTERS + DIGITS, 18, 48), some(LETTERS + DIGITS + "+/", 24, 100) + "=" * rng.randint(0, 2), some("0123456789abcdef", 32, 64), some(LETTERS[:26] + DIGITS, 16, 40), some(LETTERS[26:] + DIGITS, 16, 40), some(LETTERS + DIGITS + "-_", 20, 60), some(LETTERS, 18, 40), f"{word()[:3]}_{some(LETTERS + DIGITS, 20, 40)}", ".".join(some(LETTERS + DIGITS + "-_", 16, 70) for _ in range(rng.randint(2, 3))), "-".join(some("0123456789abcdef", 4, 12) for _ in range(rng.randint(3, 6)))]
    short = [some(LETTERS + DIGITS + "!@#$%^&*", 7, 14), f"{word().title()}{rng.randint(0, 9)}{rng.choice('!#$%&*?@')}{rng.choice(LETTERS)}", f"{rng.choice(LETTERS)}{rng.randint(0, 9)}{word()[:4]}{rng.randint(0, 99)}{word()[:3]}{rng.choice('!#$%&*?@')}{rng.randint(0, 9)}"]
    dull = [f"{word()}_{word()}_{word()}_{rng.randint(0, 9)}", f"your-{word()}-key-{rng.randint(1000, 1999)}", "x" * rng.randint(8, 20) + "123", f"{word()}/{word()}/v{rng.randint(0, 9)}.{word()}", f"{word()}{word().title()}{word().title()}{rng.randint(0, 99)}", f"{word()}-{word()}-20{rng.randint(10, 29)}.{rng.choice(['tar.gz', 'docx', 'json'])}", f"example-{word()}-{rng.randint(100, 999)}", "0123456789abcdef"[: rng.randint(10, 16)]]
    words_only = [word(), f"{word()} {word()}", f"${{{word().upper()}}}", f"get_{word()}", "changeme", "your_password", f"<{word()}-{word()}>", f"{word()}.{word()}()"]
    for v in (*keys, *short):
        yield v, named(), after(quote), path, 1
    upper, base64 = LETTERS[:26] + DIGITS, LETTERS + DIGITS + "+/"
    provided = [f"{rng.choice(['AKIA', 'ASIA'])}{some(upper, 16, 16)}", f"gh{rng.choice('pousr')}_{some(LETTERS + DIGITS, 36, 40)}", f"{rng.choice('sr')}k_{rng.choice(['live', 'test'])}_{some(LETTERS + DIGITS, 16, 40)}", f"glpat-{some(LETTERS + DIGITS, 20, 20)}", f"AIza{some(LETTERS + DIGITS, 35, 35)}", f"xox{rng.choice('abp')}-{some(DIGITS, 10, 12)}-{some(LETTERS + DIGITS, 20, 24)}"]
    for v in provided:
        yield v, rng.choice([plain(), named(), f"{before[-24:]} "]), after(rng.choice(["", quote])), path, 1
    for v in (f"AKIA{some(upper, 9, 9)}EXAMPLE", f"AKIA{'X' * 16}", f"ghp_{'x' * 36}", f"sk_test_{'0' * 24}"):
        yield v, rng.choice([plain(), named(), f"{before[-24:]} "]), after(""), path, 0
    kind, lines = rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), [some(base64, 64, 64) for _ in range(rng.randint(1, 6))]
    for end in ("\n", f"\n-----END {kind}PRIVATE KEY-----"):
        yield f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(lines) + end.rstrip("\n"), rng.choice([plain(), named(), "\n", ""]), "\n", path, 1
    for v in (*short, some(LETTERS + DIGITS, 8, 24), f"{word()}{rng.randint(1, 9999)}"):
        yield v, f"{word()} {rng.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{word()}:", f"@{word()}.{word()}", path, 1
    for v in (word(), f"${{{word()}}}", "password", f"<{word()}>"):
        yield v, f"{word()} {rng.choice(['postgres', 'https', 'redis'])}://{word()}:", f"@{word()}.{word()}", path, 0
    for v in keys:
        yield v, f"{before[-24:-10]} {digest} ", after(rng.choice(["", '"'])), path, 0
        yield v, plain(), after(""), path, 0
        yield v, f"see https://host/{word()}/", after(""), path, 0
    for v in (*dull, *words_only):
        yield v, named(), after(quote), path, 0
    for v in dull:
        yield v, plain(), after(""), path, 0


def weak_findings(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", path: str = "source", sample: int = SAMPLE) -> list[tuple]:
    """Labelled findings from the sample candidates of least hash; made-up ones where a corpus has none."""
    found = _found(docs, text, path).withColumn("h", F.xxhash64("value", "before"))
    each = max(1, sample // (2 * MADE))
    rows = found.orderBy("h", "value", "before", "after", "path").limit(each).collect()
    order = sorted(vocabulary.words)
    seeds = [(hashlib.sha1(str(i).encode()).hexdigest(), f'{order[i]} {order[2 * i]} token = "', '"', "") for i in range(each)]
    return [x for r in [*(tuple(r)[:4] for r in rows), *seeds] for x in _varied(*r, order)]


class Forest:
    """A fitted forest's trees as nested tuples (feature, threshold, left, right), and leaves as probabilities."""

    def __init__(self, model: RandomForestClassificationModel):
        def node(java: object) -> tuple | float:
            if java.subtreeDepth() == 0:
                counts = [float(x) for x in java.impurityStats().stats()]
                return counts[1] / (sum(counts) or 1)
            return java.split().featureIndex(), java.split().threshold(), node(java.leftChild()), node(java.rightChild())

        self.trees = [node(tree._java_obj.rootNode()) if hasattr(tree, "_java_obj") else node(tree._call_java("rootNode")) for tree in model.trees]

    def probability(self, x: list[float]) -> float:
        total = 0.0
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            total += tree
        return total / len(self.trees)


def fit(spark, findings: list[tuple], vocabulary: Vocabulary, trees: int = 30, depth: int = 10, seed: int = 7) -> Forest:
    """findings: (value, before, after, path, label), a bounded sample."""
    each = [np.array(features(*f[:4], forms_of(*f[:3]), vocabulary)) for f in findings]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int32)]).astype(np.int32)
    table = pa.table({"x": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0), *each]))), "label": pa.array([float(f[4]) for f in findings], pa.float64())})
    del each
    data = spark.createDataFrame(table).select(array_to_vector("x").alias("features"), "label")  # a table needs no Python workers
    forest = Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data))
    del table, data
    release()  # of the driver
    return forest


def train(docs: DataFrame, ranks_path: str, *, findings: DataFrame | None = None, sample: int = SAMPLE, text: str = "text", path: str = "source") -> Forest:
    """The forest of labelled findings (at most sample of them, by least hash), or of weak ones from docs."""
    bounded_batches(docs.sparkSession)
    vocabulary = dictionary(ranks_path)
    if findings is None:
        rows = weak_findings(docs, vocabulary, text, path, sample)
    else:
        cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("value", "before", "after", "path")]
        rows = [tuple(r)[:5] for r in findings.where("label IS NOT NULL AND length(value) > 0").select(*cols, "label").orderBy(F.xxhash64("value", "before"), "value", "before").limit(sample).collect()]
    return fit(docs.sparkSession, rows[:sample], vocabulary)


def _scanned(docs: DataFrame, forest: Forest, ranks_path: str, text: str, path: str, cutoff: float, mask: str) -> DataFrame:
    """Rows of docs as the struct row, with n_candidates, secrets and redacted beside it."""
    bounded_batches(docs.sparkSession)
    fields = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = dictionary(ranks_path)
        for batch in batches:
            counts, found, redacted = [], [], []
            for t, p in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist()):
                spans, n = [], 0
                for a, b, forms in candidates(t or ""):
                    n += 1
                    probability = forest.probability(features(t[a:b], t[max(0, a - BEFORE) : a], t[b : b + AFTER], p, forms, vocabulary))
                    if probability >= cutoff and spans and a < spans[-1]["end"]:
                        spans[-1]["end"], spans[-1]["probability"] = max(b, spans[-1]["end"]), max(probability, spans[-1]["probability"])
                    elif probability >= cutoff:
                        spans.append({"start": a, "end": b, "probability": probability})
                if spans:
                    ends = [0, *(s["end"] for s in spans)]
                    t = "".join(t[e : s["start"]] + mask for e, s in zip(ends, spans)) + t[ends[-1] :]
                counts.append(n)
                found.append(spans)
                redacted.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64()), pa.array(found, fields), pa.array(redacted, pa.string())], ["row", "n_candidates", "secrets", "redacted"])

    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), where.alias("path"))
    return rows.mapInArrow(look, f"row {rows.schema['row'].dataType.simpleString()}, n_candidates long, secrets array<struct<start:bigint,end:bigint,probability:double>>, redacted string")


def scan(docs: DataFrame, forest: Forest, ranks_path: str, *, text: str = "text", path: str = "source", cutoff: float = CUTOFF, mask: str = "[SECRET]") -> DataFrame:
    """docs with n_candidates, secrets (start, end, probability) and redacted (the text with secrets masked); own
    columns of these names are left out."""
    found = ["n_candidates", "secrets", "redacted"]
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in found]
    return _scanned(docs, forest, ranks_path, text, path, cutoff, mask).select(*own, *found)


def secret_report(docs: DataFrame, ranks_path: str, **options) -> DataFrame:
    """Per document: n_candidates, n_secrets, their ranges, and the digest of the redacted text."""
    rows = docs.select("doc_id", "text", *[c for c in ("source",) if c in docs.columns])
    found = scan(rows, train(rows, ranks_path, **options), ranks_path)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


def mask_secrets(docs: DataFrame, ranks_path: str, **options) -> DataFrame:
    """docs with secrets masked in text, and n_chars, if there, of the masked text; all other columns as they are."""
    found = _scanned(docs, train(docs, ranks_path, **options), ranks_path, "text", "source", CUTOFF, "[SECRET]")
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    return found.select(*[(F.when(F.size("secrets") > 0, changed[c]).otherwise(x) if c in changed else x).alias(c) for c, x in own.items()])
