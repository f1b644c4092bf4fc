"""Secret scans: candidate strings, then a random forest that removes the false positives.

A candidate is a run of at least ``MIN_RUN`` token characters, the value assigned to a name that speaks of
a credential or standing behind it after white space, of whatever length, or the password of user:password@host.
What of these is no credential, the forest rejects.  Its features: length,
transitions between character classes and along a letter-pair table, how much of it dictionary words
cover, whether it lies in a path, and the words before it.  The forest is trained from labelled findings: public
credential formats and look-alikes (digests after "commit", UUIDs in paths, card and phone numbers,
placeholders, long words, file names) set between words of the documents, where the
label is known by construction.  Trees are grown one per task.

The words of all texts are counted, those of candidates left out (else every credential would be made of known words).  The
counts give the dictionary, a table that meets the candidates in a join and is never sent whole; the letter-pair table; and
the words of the training lines, each as often as its share of all words asks for (``FILLERS`` in all).  Every text is
scanned whole.  Null and empty texts have no findings; repeated rows are scanned row by row; an empty table gives an
empty result (the forest then knows no words, but works).  Extra columns are ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, unused
from .words import LOWER, slices, spans

MIN_RUN = 16
FINDINGS = 6000
#: Words between which the training lines are set.
FILLERS = 40_000
TREES = 24
DEPTH = 9
THRESHOLD = 0.5

_run = np.ones(256, bool)  # separators: all but token characters
_run[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.~"]] = False
_named = regex.compile(r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|passphrase|credential|auth)[\w-]*+[\"']?(?:\s{0,3}[:=]{1,2}>?\s{0,3}|\s{1,3})[\"']?([^\s\"'<>(){},;:=][^\s\"'<>(){},;]*+)")
_speaks = regex.compile(r"(?i)key|token|secret|passw|pwd|passphrase|credential|auth")
_speaks_bytes = regex.compile(rb"key|token|secret|passw|pwd|passphrase|credential|auth")
#: user:rest of a run without separators; the password ends at the last @ of the rest.
_login = regex.compile(r"(?<![^\s/?#\"'<>])[^\s/?#\"'<>:@]*+:([^\s/?#\"'<>]++)")
_word = regex.compile(r"[^\W\d_]+")
#: Words before a finding that speak for or against a credential.
FOR = frozenset("token key apikey api secret password passwd pwd auth bearer credential credentials private access login".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid guid id isbn phone tel card order version build file path example sample placeholder test dummy".split())
NEAR = 48
FEATURES = ["length", "digits", "upper", "lower", "symbols", "changes", "distinct", "entropy", "hex", "pairs", "covered", "longest_word", "slashes", "dots", "dashes", "in_path", "extension", "speaks_for", "speaks_against", "assigned", "quoted", "repeats", "all_digits", "before_at", "after_space"]


def parts_of_words(low: str, lengths: list[int]) -> set[str]:
    """All stretches of letters with one of these (ascending) lengths: what may be a dictionary word."""
    out = set()
    for m in _word.finditer(low):
        a, b = m.span()
        for n in lengths:
            if n > b - a:
                break
            out.update(low[k : k + n] for k in range(a, b - n + 1))
    return out


class Reader:
    """Candidates of a text and their features, with dictionary words and the letter-pair table."""

    def __init__(self, words: set[str], pairs: dict[str, float]):
        self.words, self.pairs = words, pairs
        self.unseen = min(pairs.values(), default=-8.0)
        self.longest = max(map(len, words), default=0)

    def candidates(self, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Character ranges, ordered, none inside another."""
        out = {}
        for a, b in runs:
            b = a + len(text[a:b].rstrip(".-/"))
            if b - a >= MIN_RUN:
                out[a] = b
        if _speaks.search(text):
            for m in _named.finditer(text):
                a, b = m.span(1)
                while b > a and not text[b - 1].isalnum() and text[b - 1] not in "=+/_-!$%&*":
                    b -= 1
                if b > a:
                    for x in [x for x, y in out.items() if x < a <= y]:  # a run with the name in it
                        b, end = max(b, out.pop(x)), x + len(text[x : m.start()].rstrip(".-/"))
                        if end - x >= MIN_RUN:
                            out[x] = end
                    out[a] = max(b, out.get(a, 0))
        logins = {}
        if "@" in text and ":" in text:
            for m in _login.finditer(text):
                a = m.start(1)
                b = text.rfind("@", a, m.end())
                if b > a and (text[b + 1 : b + 2].isalnum() or text[b + 1 : b + 2] == "["):
                    logins[a] = b
        # What stands before and behind such a password is no part of it.
        for a, b in logins.items():
            out = {x: min(y, b) if x == a else y for x, y in out.items() if y <= a or x >= b or x == a}
            out[a] = b
        kept: list[tuple[int, int]] = []
        for a, b in sorted(out.items()):
            if kept and a < kept[-1][1]:
                kept[-1] = (kept[-1][0], max(b, kept[-1][1]))
            else:
                kept.append((a, b))
        return kept

    def coverage(self, low: str) -> tuple[float, int]:
        """The share of the string under dictionary words of 4 letters or more, left to right, and the longest."""
        covered = longest = at = 0
        while at < len(low):
            for n in range(min(self.longest, len(low) - at), 3, -1):
                if low[at : at + n] in self.words:
                    covered, longest, at = covered + n, max(longest, n), at + n
                    break
            else:
                at += 1
        return covered / max(1, len(low)), longest

    def features(self, text: str, a: int, b: int, cover: tuple[float, int] | None = None) -> list[float]:
        """``cover``: what ``coverage`` gives, if known."""
        s = text[a:b]
        low, n = s.lower(), len(s)
        classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in s]
        counts = Counter(s)
        covered, longest = self.coverage(low) if cover is None else cover
        likely = sum(self.pairs.get(low[k : k + 2], self.unseen) for k in range(n - 1)) / max(1, n - 1)
        left = text[max(0, a - NEAR) : a]
        beside = [w.lower() for w in _word.findall(left)][-3:]
        tail = left.rstrip(" \"'`")
        kind = Counter(classes)
        return [
            math.log(n), kind["d"] / n, kind["u"] / n, kind["l"] / n, kind["s"] / n, sum(x != y for x, y in zip(classes, classes[1:], strict=False)) / n,
            len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), float(all(c in "0123456789abcdef" for c in low)), likely, covered, longest,
            s.count("/") / n, s.count(".") / n, s.count("-") / n, float(left[-1:] in ("/", "\\", "@") or "://" in left[-12:]), float(bool(regex.search(r"\.[a-z]{2,4}$", low))),
            float(sum(w in FOR for w in beside)), float(sum(w in AGAINST for w in beside)), float(tail[-1:] in ("=", ":") or tail[-2:] == "=>"), float(left[-1:] in "\"'`" and bool(left)),
            max(counts.values()) / n, float(kind["d"] == n - kind["s"]), float(text[b : b + 1] == "@"), float(left[-1:].isspace() and bool(_speaks.search(left[-16:]))),
        ]


def _texts(column) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """(row, text, token runs as character ranges) for the rows of an Arrow column that may hold a candidate."""
    for lo, hi, offsets, data in slices(column):
        start, end, row = spans(data, offsets, _run)
        long = end - start >= MIN_RUN
        start, end, row = start[long], end[long], row[long]
        # Byte positions to character positions: continuation bytes before them don't count.
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        signs = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data == ord("=")) | (data == ord(":")), out=signs[1:])
        wanted = set(row.tolist()) | set(np.flatnonzero(signs[offsets[1:]] > signs[offsets[:-1]]).tolist())
        low = LOWER[data].tobytes()
        wanted |= set((np.searchsorted(offsets, [m.start() for m in _speaks_bytes.finditer(low)], "right") - 1).tolist())
        runs: dict[int, list] = {}
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            first = int(lead[offsets[r]])
            runs.setdefault(r, []).append((int(lead[a]) - first, int(lead[b]) - first))
        for r in sorted(wanted):
            yield lo + r, bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace"), runs.get(r, [])


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, share of secrets."""

    def __init__(self, trees: list[dict]):
        self.trees = [{k: np.asarray(v) for k, v in t.items()} for t in trees]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                f = t["feature"][at]
                go = f >= 0
                side = x[np.arange(len(x)), np.maximum(f, 0)] <= t["threshold"][at]
                at = np.where(go, np.where(side, t["left"][at], t["right"][at]), at)
            total += t["value"][at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, seed: int) -> dict:
    """One tree on a bootstrap of the findings, a random third of the features tried at every split."""
    rng = np.random.default_rng(seed)
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(tree["value"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", me), ("right", me), ("value", float(y[rows].mean()))):
            tree[k].append(v)
        if depth == DEPTH or len(rows) < 6 or y[rows].min() == y[rows].max():
            return me
        best = (1e-9, -1, 0.0)
        base = tree["value"][me] * (1 - tree["value"][me])
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, ones = cut + 1, np.cumsum(t)[cut]
            m, rest = len(t) - n, t.sum() - ones
            gain = base - (ones / n * (1 - ones / n) * n + rest / m * (1 - rest / m) * m) / len(t)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                middle = float((v[cut[k]] + v[cut[k] + 1]) / 2)
                best = (float(gain[k]), int(f), middle if middle < v[cut[k] + 1] else float(v[cut[k]]))  # neither side is empty
        if best[1] >= 0:
            side = x[rows, best[1]] <= best[2]
            tree["feature"][me], tree["threshold"][me] = best[1], best[2]
            tree["left"][me] = node(rows[side], depth + 1)
            tree["right"][me] = node(rows[~side], depth + 1)
        return me

    node(rng.integers(0, len(y), len(y)), 0)
    return tree


def labelled_findings(texts: list[str], count: int = FINDINGS, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """(line, from, to, label): credentials and look-alikes set between words of the texts."""
    rng = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split()] or ["the", "of", "and"]
    pick = lambda alphabet, n: "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))
    one = lambda options: options[int(rng.integers(len(options)))]
    hexa, b62, digits, upper = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    some = lambda n: [words[k] for k in rng.integers(0, len(words), n)]
    credentials = [lambda: pick(hexa, one([32, 40, 40, 64])), lambda: pick(b62, int(rng.integers(20, 64))), lambda: "AKIA" + pick(upper, 16), lambda: "ghp_" + pick(b62, 36), lambda: one(["sk_live_", "sk-", "pk_test_"]) + pick(b62, int(rng.integers(24, 48))), lambda: "eyJ" + pick(b62, 30) + "." + pick(b62, 60) + "." + pick(b62, 40), lambda: "xoxb-" + pick(digits, 12) + "-" + pick(b62, 24), lambda: pick(b62 + "+/", 43) + "=", lambda: pick(b62 + "_-!", int(rng.integers(10, 24)))]
    weak = lambda: one([lambda: pick(b62 + "!$%_-", int(rng.integers(4, 14))) + pick(digits, 1), lambda: one(words).strip(".,|!").lower()[:10] + pick(digits, int(rng.integers(1, 5))) + one(["", "!", pick(b62[:26], 6)]), lambda: pick(b62[:26], 16)])()
    letters = lambda: one([w for w in (w.strip(".,|!\"'") for w in some(8)) if w.isalpha()] or ["value"])
    # Half of the ordinary words are unknown ones, joined of two halves, as a dictionary never holds all words.
    joined = lambda x, y: x[: len(x) // 2 + 1] + y[len(y) // 2 :].lower()
    plain = lambda: one([letters, lambda: joined(letters(), letters()), lambda: joined(letters(), letters()).capitalize()])()
    names = ["token", "api_key", "secret", "password", "AUTH_TOKEN", "access_key", "client_secret", "apikey", "private_key"]
    own_format = {2, 3, 4, 5, 6}  # a prefix says what it is; others need a name beside them
    lookalikes = [
        lambda: (one(["commit ", "sha1 ", "md5: ", "checksum=", "digest "]), pick(hexa, one([32, 40, 64])), " "),
        lambda: (one(["/", "id=", "uuid: ", "/item/"]), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), " "),
        lambda: ("", pick(digits, int(rng.integers(16, 20))), " "),
        lambda: ("https://" + pick(b62[:26], 8) + ".example.com/", "/".join(w.strip(".,") for w in some(4)) + "/" + pick(digits, 4), " "),
        lambda: (one(["token = \"", "password=", "api_key: ", "secret = '"]), one(["your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme-changeme", "EXAMPLE_TOKEN_EXAMPLE", "****************", "<your-token-here>", "not-a-real-secret1"]), '" '),
        lambda: ("", "".join(w.strip(".,|!") .capitalize() for w in some(4)) + pick(digits, int(rng.integers(0, 3))), " "),
        lambda: ("", "_".join(w.strip(".,|!") for w in some(4)) + "_" + pick(digits, 2), " "),
        lambda: (one(["", "file ", "src/"]), "-".join(w.strip(".,") for w in some(3)) + pick(digits, 3) + one([".html", ".py", ".jpg", ".txt"]), " "),
        lambda: ("", "192.168." + pick(digits, 2) + "." + pick(digits, 3) + ":" + pick(digits, 4), " "),
        lambda: ("", pick(b62[:26], 6) + "." + pick(digits, 2) + "@mail" + pick(digits, 1) + ".example.com", " "),
        lambda: ("", one([lambda: "".join(plain().lower() for _ in range(6))[: int(rng.integers(16, 40))], lambda: "-".join(plain().lower() for _ in range(5)), lambda: one("abx-=_.") * int(rng.integers(16, 60))])(), " "),
        lambda: (one(["key ", "the key ", "token ", "secret ", "the secret ", "password ", "passwords ", "author ", "authority ", "auth ", "keyboard "]), plain(), " "),
        lambda: (one(["monkey ", "turkey ", "keyboard ", "keynote ", "authors ", "Chapter key "]), one([plain, lambda: pick(digits, int(rng.integers(1, 5)))])(), " "),
        lambda: (one(["key: ", "key=", "author: ", "Author: ", "keywords: ", "secret: ", "password: ", "token: ", "auth = "]), one([plain, lambda: pick(digits, int(rng.integers(1, 4)))])(), " "),
        lambda: (one(["mailto:", "Email:", "contact:", "https://example.com:"]), one([plain, lambda: plain().lower() + "." + plain().lower(), lambda: pick(digits, 4)])(), "@mail.example.com "),
        lambda: ("order ", "20" + pick(digits, 2) + "-" + pick(digits, 2) + "-" + pick(digits, 2) + "T" + pick(digits, 2) + ":" + pick(digits, 2), " "),
    ]
    out = []
    for k in range(count):
        head, tail = " ".join(some(6)), " ".join(some(6))
        if k % 2:
            kind = int(rng.integers(len(credentials)))
            value = credentials[kind]()
            form = rng.random()
            if form < 0.1:  # in a connection string
                value = weak()
                before, after = one(["", "", "url=", "DATABASE_URL="]) + one(["mysql://", "postgres://", "redis://", "https://", "mongodb+srv://", "amqp://", ""]) + one(["root:", "admin:", "app:", "svc_user:", pick(b62[:26], 6) + ":"]), "@" + one(["db", "localhost:5432/app", "10.0.0.7:6379", "cache.example.com/0"]) + " "
            elif form < 0.2:  # behind its name, without a sign of assignment
                value = one([weak, lambda: pick(b62, int(rng.integers(12, 40)))])()
                before, after = one(["--password ", "--token ", "-pwd ", "password ", "passwd ", "token ", "secret ", "api_key ", "Password \""]), " "
            elif form < 0.3:  # short values
                value = weak()
                before, after = one([*names, "pwd", "passwd", "DB_PASSWORD"]) + one(["=", ": ", " = ", "=\"", ":"]), one([" ", "\n"])
            elif kind in own_format and rng.random() < 0.4:
                before, after = one(["", "\"", "("]), " "
            else:
                name = one(names)
                name = name.upper() if rng.random() < 0.15 else name
                before, after = name + one([" = \"", "=", ": ", " = '", "\": \"", "=\""]), one(["\" ", " ", "'\n", "\"###", "\"!! "])
            label = 1
        else:
            before, value, after = one(lookalikes)()
            label = 0
        if rng.random() < 0.08:  # shouted passages are part of the corpus
            head, value, tail = head.upper(), value.upper(), tail.upper()
        line = f"{head} {before}{value}{after}{tail}"
        at = len(head) + 1 + len(before)
        out.append((line, at, at + len(value), label))
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n): the runs without white space of all texts, outside candidates, and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(set(), {})
        for batch in batches:
            column, counts, done = batch.column(0), Counter(), 0
            for r, text, runs in _texts(column):
                for t in column.slice(done, r - done).to_pylist():
                    counts.update((t or "").split())
                at, parts = 0, []
                for a, b in reader.candidates(text, runs):
                    parts.append(text[at:a])
                    at = b
                counts.update(" ".join([*parts, text[at:]]).split())
                done = r + 1
            for t in column.slice(done).to_pylist():
                counts.update((t or "").split())
            tokens = list(counts)
            for k in range(0, len(tokens), 10_000):
                own = tokens[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([counts[t] for t in own], pa.int64())], ["token", "n"])

    return map_batches(docs.select("text"), run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def words_of(tokens: DataFrame) -> DataFrame:
    """(word): the distinct runs of letters in the tokens, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sorted({w.lower() for t in batch.column(0).to_pylist() for w in _word.findall(t)})
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["word"])

    return map_batches(tokens.select("token"), run, "word string").distinct()


def fit(docs: DataFrame, findings: int = FINDINGS, trees: int = TREES, fillers: int = FILLERS) -> dict:
    """The dictionary, the letter-pair table and the forest, from ``docs`` (text).

    ``dictionary`` is the table of all words of 4 letters or more, ``words`` those of them that the training lines hold."""
    spark = docs.sparkSession
    tokens = cut(token_counts(docs), "tokens")
    every = cut(words_of(tokens), "words")
    # The pairs of distinct words: a table over the alphabet, not over the words.
    spots = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    counted = every.where(F.length("word") > 1).select("word", spots).groupBy(F.expr("substring(word, at, 2)").alias("pair")).agg(F.count("*").alias("n"))
    pairs = {r["pair"]: r["n"] for r in counted.collect()}
    total = sum(pairs.values())
    pairs = {p: math.log((n + 0.5) / (total + 500)) for p, n in sorted(pairs.items())}
    dictionary = every.where(F.length("word") >= 4)
    lengths = sorted(r[0] for r in dictionary.select(F.length("word")).distinct().collect())
    # A token comes as often as its share of all tokens says, rounded up or down by its hash: about ``fillers`` in all.
    total = tokens.agg(F.sum("n")).first()[0] or 1
    times = F.floor(F.col("n") * (fillers / total) + F.pmod(F.xxhash64("token"), F.lit(1 << 20)) / float(1 << 20)).cast("long")
    drawn = tokens.select("token", times.alias("times")).where("times > 0").collect()
    drawn = sorted((r["token"], r["times"]) for r in drawn)
    found = labelled_findings([" ".join([t] * n) for t, n in drawn], findings)
    asked = sorted(set().union(*[parts_of_words(line[a:b].lower(), lengths) for line, a, b, _ in found]))
    asked = spark.createDataFrame(pa.table({"word": pa.array(asked, pa.string())}))
    words = sorted(r["word"] for r in dictionary.join(asked, "word", "left_semi").collect())
    model = {"words": words, "dictionary": dictionary, "lengths": lengths, "pairs": pairs}
    reader = Reader(set(words), pairs)
    x = np.array([reader.features(line, a, b) for line, a, b, _ in found])
    y = np.array([label for *_, label in found], float)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                t = grow(x, y, seed)
                yield pa.RecordBatch.from_arrays([pa.array([seed], pa.int64()), *[pa.array([list(map(kind, t[k]))], pa.list_(at)) for k, kind, at in (("feature", int, pa.int32()), ("threshold", float, pa.float64()), ("left", int, pa.int32()), ("right", int, pa.int32()), ("value", float, pa.float64()))]], ["id", "feature", "threshold", "left", "right", "value"])

    grown = map_batches(spark.range(0, trees, 1, min(trees, 6)), one, "id bigint, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>").collect()
    model["trees"] = [{k: r[k] for k in ("feature", "threshold", "left", "right", "value")} for r in sorted(grown, key=lambda r: r["id"])]
    return model


def _candidates(docs: DataFrame, key: str, model: dict) -> DataFrame:
    """key, at, length, value, features (the cover left open) of every candidate of ``docs`` (key, text)."""
    kind, pairs = docs.schema[key].dataType.simpleString(), model["pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(set(), pairs)
        for batch in batches:
            rows: list[tuple] = []

            def made() -> pa.RecordBatch:
                row, at, length, value, x = zip(*rows, strict=True)
                ids = batch.column(0).take(pa.array(row, pa.int64()))
                return pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(value, pa.string()), pa.array(x, pa.list_(pa.float64()))], ["key", "at", "length", "value", "x"])

            for r, text, runs in _texts(batch.column(1)):
                rows += [(r, a, b - a, text[a:b], reader.features(text, a, b, (0.0, 0))) for a, b in reader.candidates(text, runs)]
                if len(rows) >= 5000:
                    yield made()
                    rows.clear()
            if rows:
                yield made()

    return map_batches(docs.select(key, "text"), run, f"key {kind}, at bigint, length bigint, value string, x array<double>")


def _covers(values: DataFrame, model: dict) -> DataFrame:
    """name (a digest), covered, longest: how dictionary words cover the distinct values that hold any."""
    lengths = model["lengths"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(parts_of_words(value.lower(), lengths))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.string())], ["name", "word"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Reader(set(words), {}).coverage(value.lower()) for value, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], ["name", "covered", "longest"])

    named = values.select(F.md5(F.col("value").cast("binary")).alias("name"), "value").dropDuplicates(["name"])
    known = map_batches(named, parts, "name string, word string").join(model["dictionary"], "word").groupBy("name").agg(F.collect_set("word").alias("words"))
    return map_batches(named.join(known, "name").select("name", "value", "words"), cover, "name string, covered double, longest bigint")


def _judged(docs: DataFrame, key: str, model: dict) -> DataFrame:
    """key, at, length, value, score of every candidate of ``docs`` (key, text)."""
    own = cut(_candidates(docs, key, model), "candidates")
    trees, places = model["trees"], [FEATURES.index("covered"), FEATURES.index("longest_word")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES)).copy()
                for place, column in zip(places, batch.columns[5:], strict=True):
                    x[:, place] = column.fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(forest.predict(x))], ["key", "at", "length", "value", "score"])

    rows = own.withColumn("name", F.md5(F.col("value").cast("binary"))).join(_covers(own.select("value"), model), "name", "left")
    rows = rows.select("key", "at", "length", "value", "x", "covered", "longest")
    return map_batches(rows, run, f"key {own.schema['key'].dataType.simpleString()}, at bigint, length bigint, value string, score double")


def findings(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, at, length (code points), value, score, is_secret."""
    return _judged(docs, "doc_id", model).select(F.col("key").alias("doc_id"), "at", "length", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, model: dict, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (and ``n_chars``, if there, counted
    again for changed texts); every row and column stays."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema, digest, spots = docs.schema, unused(docs, "__text"), unused(docs, "__secrets")
    # Equal texts have equal secrets, so a text's digest names it, whatever the ids are.
    named = F.sha2(F.col("text").cast("binary"), 256)
    secrets = _judged(docs.where("text is not null").select(named.alias("named"), "text"), "named", model).where(F.col("score") >= threshold)
    secrets = secrets.groupBy(F.col("key").alias(digest)).agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias(spots))
    rows = docs.withColumn(digest, named).join(secrets, digest, "left").select(*docs.columns, spots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            marked = batch.column(len(columns))
            hit = np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                values = columns[at].to_pylist()
                counts = None if size is None else columns[size].to_pylist()
                for r in hit.tolist():
                    text, parts, done = values[r], [], 0
                    for spot in marked[r].as_py():
                        parts += [text[done : spot["at"]], mark]
                        done = spot["at"] + spot["length"]
                    values[r] = "".join([*parts, text[done:]])
                    if counts is not None:
                        counts[r] = len(values[r])
                columns[at] = pa.array(values, columns[at].type)
                if counts is not None:
                    columns[size] = pa.array(counts, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(rows, run, schema)
