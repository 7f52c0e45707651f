"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The tagger is trained in numpy when the operator runs, from labelled spans: windows of a bounded sample of rows (SAMPLE_ROWS rows
that hold a digit or an @, in hash order), labelled by the patterns, and made-up lines that carry all kinds and things that are
none. Every kind holds a digit or an @, so only windows with one of these are run; windows overlap by half, a span that touches
an inner edge is left to the neighbour that sees it whole, and of spans that overlap those of largest total weight stay.
Pattern spans always stay; a tagger span that overlaps one is dropped.

Offsets are code points, end exclusive. Defined results: null is empty; texts without spans give empty lists (sha256 of an empty
text); repeated rows are worked on each; runs of digits of any length are handled in linear time; an empty table has no rows and
trains on made-up lines alone; columns named base or spans are replaced by the results, all others are carried along.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tagger import KINDS, PAD, Tagger, classes

#: Windows in code points, their step, and the margin at an inner edge.
SPAN, STEP, EDGE = 96, 48, 4
SAMPLE_ROWS, SAMPLE_BYTES, TRAIN_SPAN, MADE_UP = 400, 4 << 20, 64, 500
#: Least mean probability of the tags of an added span.
SURE = 0.9
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GROUP = re.compile(r"(?<![0-9.@+-])[0-9]{14,19}(?![0-9@-])")
TRIGGER = re.compile(r"[0-9@]")
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}
MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str):
    at, low = text.find("@"), 0
    while at >= 0:
        first = at
        while first > low and text[first - 1] in LOCAL:
            first -= 1
        m = HOST.match(text, at + 1) if first < at else None
        low = m.end() if m else at + 1
        if m:
            yield first, low
        at = text.find("@", low)


def addresses(text: str):
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1 + at
        for k in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[k : k + 4]):
                yield int(ends[k]) - len(parts[k]), int(ends[k + 3])


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in the order in which they are listed."""
    if not TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)] + [(a, 1, b) for a, b in addresses(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in DIALLED.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Spans to learn from: the patterns', and card numbers that stand beside other digits, which the patterns give up on."""
    base = patterns(text)
    more = [(m.start(), 2, m.end()) for m in GROUP.finditer(text) if luhn(m[0])]
    return sorted(base + [x for x in more if not any(x[0] < b and a < x[2] for a, _, b in base)])


class Windows:
    """Windows of many texts, as character classes."""

    def __init__(self, span: int, step: int):
        self.span, self.step, self.table = span, step, classes()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First code points of the windows that hold a trigger, and the windows."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.table[np.minimum(codes, 128)]
        hit = np.flatnonzero((kinds == self.table[ord("0")]) | (kinds == self.table[ord("@")])) // self.step
        k = np.unique(np.concatenate([hit, np.maximum(hit - 1, 0)]))
        first = k * self.step
        at = first[:, None] + np.arange(self.span)
        return first, np.where(at < len(kinds), kinds[np.minimum(at, len(kinds) - 1)], PAD).astype(np.uint8)


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, kind, end) of the tagged runs of a window."""
    out, t = [], 0
    while t < len(tags):
        if tags[t] and tags[t] % 2:  # begin
            end = t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            out.append((t, int(tags[t]) // 2, end))
            t = end
        else:
            t += 1
    return out


def reconciled(base: list[tuple[int, int, int]], found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """base and the heaviest set of found spans that overlap neither it nor each other, in n log n steps."""
    taken: list[list[int]] = []  # what base covers, in order
    for a, _, b in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    lows = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(lows, b) - 1  # the last that begins before b
        return k < 0 or taken[k][1] <= a

    ends = sorted((b, a, k, w) for (a, k, b), w in found.items() if free(a, b))
    stops = [e[0] for e in ends]
    best, came = [0.0], []
    for i, (b, a, k, w) in enumerate(ends):
        j = bisect_right(stops, a, 0, i)
        came.append(j if best[j] + w > best[i] else -1)
        best.append(max(best[i], best[j] + w))
    i, picked = len(ends), []
    while i:
        b, a, k, _ = ends[i - 1]
        if came[i - 1] >= 0:
            picked.append((a, k, b))
        i = came[i - 1] if came[i - 1] >= 0 else i - 1
    return sorted(base + picked)


def parted(a: int, k: int, b: int, text: str) -> list[tuple[int, int, int]]:
    """A span, or of one with more digits than its kind may have, those parts at white space that are of that kind by themselves."""
    most = MOST_DIGITS.get(KINDS[k])
    if most is None or sum(c.isdigit() for c in text[a:b]) <= most:
        return [(a, k, b)]
    return [(a + m.start(), k, a + m.end()) for m in re.finditer(r"\S+", text[a:b]) if KINDS[k] == "card" and m[0].isascii() and m[0].isdigit() and 14 <= len(m[0]) <= most and luhn(m[0])]


def added(texts: list[str], base: list[list], model: Tagger, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """All spans of each text."""
    windows, owner, firsts, parts = Windows(SPAN, STEP), [], [], []
    for i, text in enumerate(texts):
        if TRIGGER.search(text):
            first, w = windows.of(text)
            owner.append(np.full(len(first), i))
            firsts.append(first)
            parts.append(w)
    found: list[dict] = [{} for _ in texts]
    if owner:
        owner, firsts, parts = np.concatenate(owner), np.concatenate(firsts), np.concatenate(parts)
        for lo in range(0, len(parts), batch):
            e = model.emissions(parts[lo : lo + batch])
            tags = model.paths(e)
            some = np.flatnonzero(tags.any(axis=1))
            if not len(some):
                continue
            p = model.marginals(e[some])
            for row, q in zip(some, p):
                i, first = int(owner[lo + row]), int(firsts[lo + row])
                text = texts[i]
                for a, k, b in spans_of(tags[row]):
                    if (first and a < EDGE) or (b > SPAN - EDGE and first + SPAN < len(text)):
                        continue
                    sure = float(q[np.arange(a, b), tags[row, a:b]].mean())
                    body = text[first + a : first + b]
                    if sure >= SURE and sum(c.isdigit() for c in body) >= LEAST_DIGITS[KINDS[k]] and (k or "@" in body) and body == body.strip():
                        for key in parted(first + a, k, first + b, text):
                            found[i][key] = max(found[i].get(key, 0.0), sure * (key[2] - key[0]))
    return [reconciled(x, y) for x, y in zip(base, found)]


def made_up(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with spans of all kinds and with other things that hold digits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlucmé") for _ in range(rng.randint(1, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card():
        d, gap = num(rng.choice((13, 14, 15, 15, 15, 18))), rng.choice(("", "", " ", "-"))
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))

    real = (
        lambda: f"{word()}{rng.choice(('', '.', '_', '+'))}{rng.choice((word(), num(2)))}@{word()}{rng.choice(('', num(1)))}.{rng.choice(('example.com', 'org', 'co.uk'))}".replace("é", "e"),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: rng.choice((f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"+{num(11)}", f"+{num(2)}-{num(3)}-{num(3)}-{num(4)}")),
    )
    other = (lambda: f'token = "{hexa(40)}"', lambda: f"password={hexa(18)}", lambda: "AKIA" + hexa(16).upper(), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: num(rng.randint(1, 9)), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"@{word()}", lambda: f"${num(2)}.{num(2)}")
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 7))), []
        for _ in range(rng.randint(0, 2)):
            text += rng.choice((" ", ". ", ", ", "\n", "."))
            k = rng.randrange(6)
            if k < 4:
                one = real[k]()
                if k != 0 or text[-1:] != ".":
                    spans.append((len(text), k, len(text) + len(one)))
                else:
                    text += " "
                    spans.append((len(text), k, len(text) + len(one)))
                text += one
            else:
                text += rng.choice(other)()
            text += rng.choice((" ", ". ", ", ", "\n")) + " ".join(word() for _ in range(rng.randint(1, 4)))
        out.append((text, spans))
    return out


def windows_with_tags(lines: list[tuple[str, list[tuple[int, int, int]]]], span: int = TRAIN_SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of labelled lines. A window that would cut a span begins a little earlier or is left out."""
    windows, xs, ys = Windows(span, span // 2), [], []
    for text, spans in lines:
        if not text:
            continue
        first, x = windows.of(text) if TRIGGER.search(text) else (np.zeros(0, int), None)
        for k, at in enumerate(first):
            if any(a < at < b or a < at + span < b for a, _, b in spans):
                continue
            y = np.zeros(span, int)
            for a, kind, b in spans:
                if at <= a and b <= at + span:
                    y[a - at], y[a - at + 1 : b - at] = 1 + 2 * kind, 2 + 2 * kind
            xs.append(x[k])
            ys.append(y)
    return np.array(xs), np.array(ys)


def train(texts: list[str], made: int = MADE_UP, steps: int = 480) -> Tagger:
    """From texts, labelled by the patterns, and made-up lines; windows of both weigh alike."""
    own = windows_with_tags([(t, labelled(t)) for t in texts])
    others = windows_with_tags(made_up(made))
    x, y = others
    if len(own[0]):
        pick = np.random.default_rng(5).permutation(len(own[0]))[: 2 * len(x)]
        x, y = np.concatenate([x, own[0][pick]]), np.concatenate([y, own[1][pick]])
    model = Tagger()
    model.train(x, y, steps)
    return model


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[str]:
    """Texts to learn from: at most `rows` with a digit or an @, and at most `size` bytes, in hash order."""
    some = common.written(docs.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("order"), F.octet_length("text").alias("bytes")))
    left, picks = size, []
    for r in some.distinct().orderBy("order", "bytes").limit(rows).collect():
        if r["bytes"] <= left:  # a text that doesn't fit the bytes left is passed over
            left -= r["bytes"]
            picks.append((r["order"], r["bytes"]))
    if not picks:
        return []
    order, sizes = zip(*picks)
    taken = F.broadcast(common.local(docs.sparkSession, order=(order, pa.int64()), bytes=(sizes, pa.int32())))
    own = docs.filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("order"), F.octet_length("text").alias("bytes"))
    return [r["text"] for r in own.join(taken, ["order", "bytes"], "left_semi").select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(rows).collect()]


def find(docs: DataFrame, model: Tagger | None = None, redact: bool = False) -> DataFrame:
    """docs with base and spans (arrays of kind:start:end); with redact=True text has [KIND] in place of each span."""
    model = model or train(sample(docs))
    kept = [c for c in docs.columns if c not in ("base", "spans", "text")]

    def run(batches):
        for batch in common.sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [patterns(t) for t in texts]
            every = added(texts, base, model)
            named = lambda rows: pa.array([[f"{KINDS[k]}:{a}:{b}" for a, k, b in x] for x in rows], pa.list_(pa.string()))
            text = pa.array([None if o is None else masked(t, x) for o, t, x in zip(batch.column("text").to_pylist(), texts, every)], pa.string()) if redact else batch.column("text").cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text, named(base), named(every)], names=[*kept, "text", "base", "spans"])

    names = [*kept, "text"]
    schema = docs.select(*names).schema
    schema = schema.add("base", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StringType()))
    return docs.select(*names).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one mark, that of the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 are of the pattern spans, spans of all."""
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
