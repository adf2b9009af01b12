"""Secret scans: base patterns, and a character convolutional network over every candidate and its context.

Base patterns give spans of three kinds (assign, access, hex). Candidates are those spans and every run of 16 or
more token characters with a digit in it. The network, plain numpy, reads windows of WITHIN characters and the text
around them, over the whole candidate; a candidate outside all base spans of which it accepts one becomes a span of
kind `model`.

Training, on the driver and the same for every run: labelled findings from a seeded generator of secrets and of
things that look like them (card numbers, hosts, identifiers, paths), secrets glued to long names and paths, and windows
of the base spans of all documents, of distinct ones those TRAIN_WINDOWS with the smallest hashes. Candidates outside the
base spans are no examples of anything, as nobody has labelled them. A held-back quarter calibrates the network (Platt
scaling). The threshold is the largest that keeps RECALL of held-back findings (other seeds, never trained on) outside
the base patterns, the only ones it decides; each is taken as scan() sees it, the whole run by its best window.

Every candidate and every base span is scored; base spans stay whatever the score, n_confirmed counts those of them
that the network accepts.

One pass without a shuffle. Offsets are code points, ends exclusive. Defined results: null text counts as empty and
has no span; repeated rows are scanned each; an empty table gives no rows; other columns are ignored (kept by
`redacted`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.llm.common import prepare, slices, table, text_column
from vedette.llm.textkit import text_bytes

#: Windows of base spans that the network is trained on at most.
TRAIN_WINDOWS = 3_200
RECALL = 0.98
KINDS = ("assign", "access", "hex", "model")

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]  # the maximal runs of 24 and more
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


#: Input of the network: characters before the window, of it, and after it; characters from a window to the next, and
#: windows that go through the network together.
BEFORE, WITHIN, AFTER = 24, 40, 12
STEP, TOGETHER = 10, 2048
LENGTH = BEFORE + WITHIN + AFTER
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-:\"' \n,;!?()[]{}<>@#$%&*|\\"
_CODE = {c: i + 1 for i, c in enumerate(_SYMBOLS)}
N_SYMBOLS = len(_SYMBOLS) + 2
FILTERS, WIDTH = 24, 5


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows of WITHIN characters over all of a candidate; the last ends with it."""
    return [(s, s + WITHIN) for s in [*range(start, end - WITHIN, STEP), end - WITHIN]] if end - start > WITHIN else [(start, end)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """[2, LENGTH]: symbols, and 1 inside the candidate, 2 there for a capital."""
    left, inside, right = text[max(0, start - BEFORE) : start], text[start : min(end, start + WITHIN)], text[end : end + AFTER]
    out = np.zeros((2, LENGTH), np.int64)
    for at, part, mark in ((BEFORE - len(left), left, 0), (BEFORE, inside, 1), (BEFORE + WITHIN, right, 0)):
        for i, c in enumerate(part):
            low = c.lower()
            out[0, at + i] = _CODE.get(low, N_SYMBOLS - 1)
            out[1, at + i] = mark * (1 + (low != c))
    return out


@dataclass
class Network:
    """Convolution over symbols, rectifier, maximum and mean over positions, logistic output."""

    table: np.ndarray  # [WIDTH, symbols, FILTERS]
    marks: np.ndarray  # [WIDTH, 3, FILTERS]
    bias: np.ndarray
    out: np.ndarray  # [2 * FILTERS]
    shift: np.ndarray  # [1]
    slope: float = 1.0  # Platt scaling
    offset: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray) -> np.ndarray:
        n = LENGTH - WIDTH + 1
        h = np.broadcast_to(self.bias, (len(x), n, FILTERS)).copy()
        for o in range(WIDTH):
            h += self.table[o][x[:, 0, o : o + n]]
            h += self.marks[o][x[:, 1, o : o + n]]
        return np.maximum(h, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = self.hidden(x)
        return np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1) @ self.out + self.shift[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.offset, -35, 35)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64) -> Network:
    """Adam on the logistic loss, then calibration and a threshold by rows on every fourth row; train() sets its own."""
    rng = np.random.default_rng(11)
    net = Network(rng.normal(0, 0.1, (WIDTH, N_SYMBOLS, FILTERS)), rng.normal(0, 0.1, (WIDTH, 3, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1))
    held = np.arange(len(x)) % 4 == 3
    train, n = np.flatnonzero(~held), LENGTH - WIDTH + 1
    names = ("table", "marks", "bias", "out", "shift")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            xb, h = x[rows], net.hidden(x[rows])
            top = h.argmax(axis=1)
            pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift[0], -35, 35)))
            d = (p - y[rows]) / len(rows)
            dh = np.broadcast_to((d[:, None] * net.out[FILTERS:] / n)[:, None, :], h.shape).copy()
            i, f = np.indices(top.shape)
            dh[i, top, f] += d[:, None] * net.out[:FILTERS]
            dh *= h > 0
            g = {"out": pooled.T @ d + 1e-4 * net.out, "shift": np.array([d.sum()]), "bias": dh.sum(axis=(0, 1)), "table": np.zeros_like(net.table), "marks": np.zeros_like(net.marks)}
            flat = dh.reshape(-1, FILTERS)
            for o in range(WIDTH):
                for k, channel, kinds in (("table", 0, N_SYMBOLS), ("marks", 1, 3)):
                    one = np.zeros((flat.shape[0], kinds), np.float32)
                    one[np.arange(flat.shape[0]), xb[:, channel, o : o + n].reshape(-1)] = 1
                    g[k][o] = one.T @ flat
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, getattr(net, k) - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    logits, truth = net.logits(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling with a weak prior on the slope
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -35, 35)))
        w = p * (1 - p)
        grad = np.array([((p - truth) * logits).sum() + 0.5 * (a - 1), (p - truth).sum() + 0.1 * b])
        hess = np.array([[(w * logits**2).sum() + 0.5, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    net.slope, net.offset = float(a), float(b)
    net.threshold = recall_threshold(net.probability(x[held])[truth == 1])
    return net


def recall_threshold(found: np.ndarray) -> float:
    """The largest threshold that accepts RECALL of these probabilities of true findings; 0.5 where there are none."""
    return float(np.sort(found)[int((1 - RECALL) * len(found))]) if len(found) else 0.5


def labelled_findings(n: int = 1600, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Seeded (text, start, end, is_secret) examples."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits
    word = lambda: pick(letters, int(rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 7))))
    out = []
    for i in range(n):
        kind = i % 12
        if kind < 6:  # secrets in the places where they leak
            value = (pick(mixed, int(rng.integers(20, 44))), pick("abcdef" + digits, 40), "AKIA" + pick(letters.upper() + digits, 16), pick(mixed + "+/", 40) + "=", "sk_" + pick(mixed, 28), pick(mixed + "-_", 32))[int(rng.integers(6))]
            lead = ("auth = '", "Authorization: Bearer ", "access key: ", "private_key=", "credential \"", "pw: ", "client key = ", "bearer ", "token = \"", "")[int(rng.integers(10))]
        else:  # what only looks like one
            value = (
                pick(digits, 16), f"{word()}-{word()}-{word()}-{pick(digits, 4)}", f"mail{pick(digits, 1)}-{word()}-{word()}{word()}-com", f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 6)}-{pick(digits, 4)}",
                f"/{word()}/{word()}/{word()}/{word()}{pick(digits, 2)}", f"{word()}_{word()}_{word()}_v{pick(digits, 1)}", pick(digits, int(rng.integers(16, 24))), word() + word() + word() + word() + pick(digits, 1), pick("=-_", 18) + pick(digits, 1),
            )[int(rng.integers(9))]
            value = value if len(value) >= 16 else value + pick(digits, 16 - len(value))
            lead = ("card ", "see ", "at ", "order ", "page ", "from ", "id ", "file ", "")[int(rng.integers(9))]
        before = f"{prose()}{('. ', ' ', chr(10))[int(rng.integers(3))]}{lead}"
        out.append((f"{before}{value}{('', ' ', '. ', chr(39), chr(34), ', ')[int(rng.integers(6))]} {prose()}", len(before), len(before) + len(value), int(kind < 6)))
    return out


def glued_findings(n: int = 480, seed: int = 6) -> list[tuple[str, int, int, int, int]]:
    """Seeded (text, start, end, start of the secret, its end) of long candidates: a path or name with a secret at its end, or with none."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits
    parts = (*"srv app config deploy production staging credentials service account private storage default internal backup client user settings session data model cache the and for".split(), *(pick(letters, int(rng.integers(2, 9))) for _ in range(200)))
    out = []
    for i in range(n):
        mark, size = "/_-"[int(rng.integers(3))], int(rng.integers(24, 100))
        lead = mark if mark == "/" else ""
        while len(lead) < size:
            lead += str(rng.choice(parts)) + (pick(digits, int(rng.integers(1, 5))) if rng.random() < 0.15 else "") + mark
        if i % 2:
            value = (pick(mixed, int(rng.integers(20, 41))), pick(mixed + "+", int(rng.integers(30, 41))), "sk_" + pick(mixed, 28), pick(mixed + "-_", 32))[int(rng.integers(4))]
            lead = (lead[:-1] + "=") if mark != "/" and rng.random() < 0.5 else lead
        else:
            value, lead = "", lead + (f"v{pick(digits, 1)}", pick(digits, 4), f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}", f"part{pick(digits, 2)}")[int(rng.integers(4))]
        before = f"{rng.choice(parts)} {rng.choice(parts)} "
        at = len(before) + len(lead)
        out.append((f"{before}{lead}{value} {rng.choice(parts)}", len(before), at + len(value), at, at + len(value)))
    return out


def glued_windows(n: int = 480, seed: int = 6) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is_secret) of the windows that hold 16 characters of a secret or none."""
    rows = []
    for text, start, end, s, e in glued_findings(n, seed):
        held = [(a, b, max(0, min(b, e) - max(a, s))) for a, b in windows(start, end)]
        rows += [(text, a, b, int(k > 0)) for a, b, k in held if k == 0 or k >= 16]
    return rows


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of token characters with a digit that touch no base span; `base` is in order of its starts."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def recall_findings(seed: int = 17) -> list[tuple[str, int, int]]:
    """Findings outside all base spans that training never sees, as candidates(): what the threshold decides."""
    secret = [(t, s, e) for t, s, e, y in labelled_findings(1600, seed) if y]
    secret += [(t, s, e) for t, _, _, s, e in glued_findings(480, seed + 1) if s < e]
    return [(t, a, b) for t, s, e in secret for a, b in candidates(t, base_spans(t)) if a < e and s < b]


def best(network: Network, found: list[tuple[str, int, int]]) -> np.ndarray:
    """The probability of each candidate by its best window."""
    return np.array([network.probability(np.stack([encode(t, *w) for w in windows(s, e)])).max() for t, s, e in found])


def base_windows(docs: DataFrame) -> DataFrame:
    """(context, start, end): the distinct windows of all base spans (of `assign`, its value), with what the network sees
    around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = set()
            for text, base in _based(batch.column(0)):
                for kind, s, e in base:
                    for a, b in windows(*ASSIGN.match(text, s).span(2) if kind == "assign" else (s, e)):
                        left = max(0, a - BEFORE)
                        rows.add((text[left : b + AFTER], a - left, b - left))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sorted(rows), strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)], ["context", "start", "end"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "context string, start int, end int").distinct()


def train(docs: DataFrame) -> Network:
    """The network; the driver gets TRAIN_WINDOWS windows of `docs` at most."""
    prepare(docs.sparkSession)
    found = base_windows(docs).orderBy(F.xxhash64("context", "start", "end"), "context", "start", "end").limit(TRAIN_WINDOWS).collect()
    rows = [*labelled_findings(), *glued_windows(), *((*r, 1) for r in found)]
    order = np.random.default_rng(3).permutation(len(rows))
    network = fit_network(np.stack([encode(*rows[i][:3]) for i in order]), np.array([rows[i][3] for i in order], float))
    network.threshold = recall_threshold(best(network, recall_findings()))
    return network


_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[ord(c) for c in "0123456789abcdef"]] = True


def _with_runs(column: pa.Array) -> np.ndarray:
    """Rows with a run of 16 token bytes that has a digit, or of 24 hex bytes: only there need the patterns look."""
    data, offsets = text_bytes(column)
    hit = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return hit
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    for chars, least, needs in ((_TOKEN_BYTE, 16, True), (_HEX_BYTE, 24, False)):
        inside = np.concatenate([[False], chars[data], [False]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turn[::2], turn[1::2]
        keep = (ends - starts >= least) & (not needs or digits[ends] > digits[starts])  # runs over two rows only look once more
        # every row from a run's first to its last: rows between may lie wholly inside it
        first, last = (np.searchsorted(offsets, at, "right") - 1 for at in (starts[keep], ends[keep] - 1))
        n = len(hit)
        hit |= np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n] > 0
    return hit


def _based(column: pa.Array) -> Iterator[tuple[str, list[Span]]]:
    """(text, base spans) of each row; where no pattern can match none is tried."""
    for text, runs in zip(text_column(column).to_pylist(), _with_runs(column), strict=True):
        low = "" if runs else text.lower()
        yield text, base_spans(text) if runs or "AKIA" in text or any(w in low for w in _WORDS) else []


def scan(network: Network, column: pa.Array) -> list[tuple[list[Span], list[Span], int]]:
    """(base spans, all spans, how many base spans the network accepts) of each row."""
    out: list[list[Span]] = []
    found: list[set[Span]] = []
    seen: list[np.ndarray] = []
    places: list[tuple[int, Span]] = []

    def look() -> None:
        for (i, span), p in zip(places, network.probability(np.stack(seen)), strict=True):
            if p >= network.threshold:
                found[i].add(span)
        seen.clear()
        places.clear()

    runs = _with_runs(column)
    for i, (text, base) in enumerate(_based(column)):
        out.append(base)
        found.append(set())
        for kind, s, e in [*base, *(("model", *c) for c in (candidates(text, base) if runs[i] else ()))]:
            for w in windows(*ASSIGN.match(text, s).span(2) if kind == "assign" else (s, e)):
                seen.append(encode(text, *w))
                places.append((i, (kind, s, e)))
                if len(seen) == TOGETHER:
                    look()
    if seen:
        look()
    by_start = lambda s: (s[1], KINDS.index(s[0]))
    return [(base, sorted([*base, *(x for x in more if x[0] == "model")], key=by_start), sum(x[0] != "model" for x in more)) for base, more in zip(out, found, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, counts by kind, the base spans' digest, all spans, and how many base spans the network accepts."""
    prepare(docs.sparkSession)
    network = network or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan(network, batch.column(1))
            count = lambda kind: pa.array([sum(s[0] == kind for s in spans) for _, spans, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(count(k) for k in ("assign", "access", "hex")), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _, _ in found]), pa.array([joined(s) for _, s, _ in found]), count("model"), pa.array([n for _, _, n in found], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_confirmed"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_confirmed long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones together) replaced by a mark of its first kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind} removed>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """`docs`, all columns, with the secrets in `text` replaced; `n_chars`, where there is one, follows."""
    prepare(docs.sparkSession)
    network = network or train(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan(network, batch.column(at))
            if any(spans for _, spans, _ in found):
                texts = batch.column(at).to_pylist()
                changed = {i: redact(texts[i], spans) for i, (_, spans, _) in enumerate(found) if spans}
                batch = batch.set_column(at, batch.schema.field(at), pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type))
                if "n_chars" in names:
                    n = names.index("n_chars")
                    sizes = batch.column(n).to_pylist()
                    batch = batch.set_column(n, batch.schema.field(n), pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(sizes)], batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op7_character_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
