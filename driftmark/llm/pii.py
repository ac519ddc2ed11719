"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on spans that the patterns found, in windows of real text. Part of these windows is
shown with the spans in spellings the patterns miss (spaces about the @ and dots of an address, a phone number
without its plus, a card number in dotted groups), so that the network learns what personal data looks like rather than
the patterns. Windows overlap: each is decoded alone by the Viterbi rule, and of overlapping spans of one kind that
neighbouring windows give, the one that lies deepest inside its window stays. Spans of the patterns always stay; the
network adds those that touch none of them.

Every kind holds a digit or an @, hence so does every window that can hold a span. Only the stretches of a text about
these characters are decoded; the rest of the text is read, and is known to hold nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 64, 32  # characters of a window, and from one to the next
HIDDEN, EMBED = 16, 12
LEAST_PROBABILITY = 0.9  # of every character of a span that the network adds
SAMPLE = 1500  # texts with spans of each kind that training windows come from, about

# The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MARKED = re.compile(r"[0-9@]")
MARKED_RUN = re.compile(r"[0-9@](?:[^0-9@]{0,31}[0-9@])*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """All matches of EMAIL, sought only about each @: a match stays within the run of its characters."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-@"):
            start -= 1
        end = at
        while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "._%+-@"):
            end += 1
        found += [m.span() for m in EMAIL.finditer(text, start, end)]
        done, at = end, text.find("@", end)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind's pattern that pass its test; leftmost, not overlapping."""
    numbers = MARKED.search(text) is not None
    return {
        "email": _emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if numbers else [],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)] if numbers else [],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if numbers else [],
    }


@cache
def _classes() -> np.ndarray:
    """Number of each character: ASCII characters have their own, save letters (by vowel, case) and digits; others by kind."""
    table = np.full(1 << 16, 1, np.int64)
    for i in range(1 << 16):
        c = chr(i)
        table[i] = 2 if c.isalpha() else 3 if c.isspace() else 4 if c.isalnum() else 1
    for i in range(33, 127):
        table[i] = i - 28
    for c in "abcdefghijklmnopqrstuvwxyz":
        table[ord(c.upper())] = table[ord(c)]
    for c in "0123456789":
        table[ord(c)] = 100
    return table


CLASSES = 101
TAGS = 1 + 2 * len(KINDS)  # outside; first character and further characters of each kind


def encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[np.minimum(points, (1 << 16) - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Parameters by name; x is (windows, characters)."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (CLASSES, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
        for side in "fb":
            p[side + "x"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            p[side + "h"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            p[side + "b"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, e: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States (characters, windows, HIDDEN) of one direction over e (characters, windows, EMBED), and what backward needs."""
        n, m, _ = e.shape
        given = e @ self.p[side + "x"] + self.p[side + "b"]
        h, c, states, kept = np.zeros((m, HIDDEN), np.float32), np.zeros((m, HIDDEN), np.float32), np.empty((n, m, HIDDEN), np.float32), []
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            z = given[t] + h @ self.p[side + "h"]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i * g
            th = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, th))
            h, c = o * th, new
            states[t] = h
        return states, kept

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (characters, windows, TAGS)."""
        e = self.p["embed"][x.T]
        (hf, kf), (hb, kb) = self._run(e, "f"), self._run(e, "b")
        h = np.concatenate([hf, hb], 2)
        return h @ self.p["out"] + self.p["out_b"], (x, e, h, kf, kb)

    def _back(self, dh: np.ndarray, e: np.ndarray, kept: list, side: str, grads: dict) -> np.ndarray:
        de = np.zeros_like(e)
        dnext, dc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        gx, gh, gb = np.zeros_like(self.p[side + "x"]), np.zeros_like(self.p[side + "h"]), np.zeros_like(self.p[side + "b"])
        for t, h, c, i, f, o, g, th in reversed(kept):
            d = dh[t] + dnext
            dc = dc + d * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), d * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            gx += e[t].T @ dz
            gh += h.T @ dz
            gb += dz.sum(0)
            de[t] = dz @ self.p[side + "x"].T
            dnext, dc = dz @ self.p[side + "h"].T, dc * f
        grads[side + "x"], grads[side + "h"], grads[side + "b"] = gx, gh, gb
        return de

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of the chain, the log total, and each character's tag probabilities."""
        n, moves = len(s), self.p["moves"]
        a, b = np.empty_like(s), np.zeros_like(s)
        a[0] = s[0]
        for t in range(1, n):
            a[t] = s[t] + _logsum(a[t - 1][:, :, None] + moves, 1)
        for t in range(n - 2, -1, -1):
            b[t] = _logsum((b[t + 1] + s[t + 1])[:, None, :] + moves, 2)
        total = _logsum(a[-1], 1)
        return a, b, total, np.exp(a + b - total[:, None])

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y (windows, characters), and its gradients."""
        s, (x, e, h, kf, kb) = self.scores(x)
        a, b, total, gamma = self.marginals(s)
        n, m, _ = s.shape
        rows = np.arange(m)
        tags = y.T
        gold = s[np.arange(n)[:, None], rows, tags].sum(0) + self.p["moves"][tags[:-1], tags[1:]].sum(0)
        ds = gamma.copy()
        ds[np.arange(n)[:, None], rows, tags] -= 1
        ds /= m
        dm = np.zeros_like(self.p["moves"])
        for t in range(n - 1):
            dm += np.exp(a[t][:, :, None] + self.p["moves"] + (b[t + 1] + s[t + 1])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(dm, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        grads = {"moves": dm / m, "out": np.tensordot(h, ds, ((0, 1), (0, 1))), "out_b": ds.sum((0, 1))}
        dh = ds @ self.p["out"].T
        de = self._back(dh[:, :, :HIDDEN], e, kf, "f", grads) + self._back(dh[:, :, HIDDEN:], e, kb, "b", grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], x.T, de)
        return float((total - gold).mean()), grads

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag of each character (windows, characters) by Viterbi, and its probability."""
        s, _ = self.scores(x)
        gamma = self.marginals(s)[3]
        n, moves = len(s), self.p["moves"]
        best, back = s[0], []
        for t in range(1, n):
            all_ = best[:, :, None] + moves
            back.append(all_.argmax(1))
            best = s[t] + all_.max(1)
        tags = np.empty((n, x.shape[0]), np.int64)
        tags[-1] = best.argmax(1)
        for t in range(n - 2, -1, -1):
            tags[t] = np.take_along_axis(back[t], tags[t + 1][:, None], 1)[:, 0]
        return tags.T, np.take_along_axis(gamma, tags[:, :, None], 2)[:, :, 0].T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def tags_of(spans: list[tuple[int, int, int]], begin: int, length: int) -> np.ndarray:
    """Tags of the characters from begin on, of spans (kind number, start, end)."""
    tags = np.zeros(length, np.int64)
    for kind, s, e in spans:
        tags[max(0, s - begin) : max(0, e - begin)] = 2 + 2 * kind
        if 0 <= s - begin < length:
            tags[s - begin] = 1 + 2 * kind
    return tags


def _respelt(kind: str, text: str, rng: random.Random) -> str:
    """The same data in a spelling that the kind's pattern misses."""
    if kind == "email":
        return text.replace("@", rng.choice([" @ ", "@ ", " @"])).replace(".", rng.choice([".", " . "]))
    if kind == "phone":
        return text.lstrip("+") if rng.random() < 0.5 else text.replace("+", "00", 1)
    if kind == "card":
        mark = rng.choice([".", "/", "  "])
        return mark.join(_digits(text)[i : i + 4] for i in range(0, 16, 4)) + _digits(text)[16:]
    return text.replace(".", rng.choice([" . ", ". "]))


def training_windows(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows about the spans and other digits of texts, and their tags."""
    rng, xs, ys = random.Random(seed), [], []

    def add(text: str, spans: list[tuple[int, int, int]], begin: int) -> None:
        part = encoded(text[begin : begin + WINDOW])
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        x[: len(part)] = part
        y[: len(part)] = tags_of(spans, begin, len(part))
        xs.append(x), ys.append(y)

    for text in texts:
        spans = sorted((s, e, KINDS.index(k)) for k, found in base_spans(text).items() for s, e in found)
        spans = [x for i, x in enumerate(spans) if not i or x[0] >= spans[i - 1][1]]
        for s, e, k in spans:
            begin = max(0, s - rng.randrange(WINDOW // 2))
            near = [(k2, a, b) for a, b, k2 in spans if b > begin and a < begin + WINDOW]
            add(text, near, begin)
            new = _respelt(KINDS[k], text[s:e], rng)
            around = text[max(0, s - WINDOW) : s] if not any(a < s and b > s - WINDOW for a, b, _ in spans) else "the "
            after = text[e : e + WINDOW] if not any(a < e + WINDOW and b > e for a, b, _ in spans) else " and"
            shown = around + new + after
            add(shown, [(k, len(around), len(around) + len(new))], max(0, len(around) - rng.randrange(WINDOW // 2)))
        others = [m.start() for m in MARKED.finditer(text) if not any(a <= m.start() < b for a, b, _ in spans)]
        for at in rng.sample(others, min(2, len(others))):
            begin = max(0, at - rng.randrange(WINDOW // 2))
            add(text, [(k2, a, b) for a, b, k2 in spans if b > begin and a < begin + WINDOW], begin)
    return (np.array(xs), np.array(ys)) if xs else (np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64))


def train(texts: list[str], rounds: int = 250, batch: int = 64) -> Tagger | None:
    """A tagger trained on the spans of texts by Adam; None if they hold none."""
    x, y = training_windows(texts)
    if not (y > 0).any():
        return None
    tagger, rng = Tagger.fresh(), np.random.default_rng(11)
    mean = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for t in range(1, rounds + 1):
        pick = rng.integers(0, len(x), batch)
        _, grads = tagger.step(x[pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - t / (rounds + 1)) + 0.0005
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            tagger.p[k] = (tagger.p[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return tagger


def _base_matches(kind: str, text: Column) -> Column:
    """The strings of text that are base spans of kind, as Spark finds them."""
    # A closing group that repeats takes all it can and gives nothing back, which Java runs in a loop instead of a call per round.
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind].pattern
    found = F.regexp_extract_all(text, F.lit(pattern + "+" if pattern.endswith(")+") else pattern), F.lit(0))

    def passes(m: Column) -> Column:
        digits = F.regexp_replace(m, "[^0-9]", "")
        if kind == "ip":
            return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").try_cast("int").isNull() & p.rlike("^0+$") | (F.regexp_replace(p, "^0+", "").try_cast("int") <= 255))
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits) if kind == "card" else F.length(digits).between(8, 15)

    return found if kind == "email" else F.filter(found, passes)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger from the base spans of docs' texts: of each kind, from about sample texts that hold it, by a hash.

    Of each text the stretches about the first 8 spans of that kind are used, and of each kind sample stretches, so that
    what comes to the driver is bounded and no kind takes another's place.
    """
    signs = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9]([\x20-]?[0-9]){15}")}
    texts = docs.select("doc_id", F.col("text").cast("string"))
    spans = texts.select("doc_id", "text", *(F.when(signs[k], _base_matches(k, F.col("text"))).alias(k) for k in KINDS))
    n = spans.agg(*(F.count_if(F.size(k) > 0).alias(k) for k in KINDS)).first()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))

    def cut(m: Column) -> Column:
        start = F.greatest(F.position(m, F.col("text")) - 80, F.lit(1))
        return F.substring(F.col("text"), start, F.length(m) + 200)

    chosen = (F.when(place < min(1.0, sample / max(1, n[k])) * (1 << 20), F.struct(F.lit(k).alias("kind"), F.transform(F.slice(k, 1, 8), cut).alias("parts"))) for k in KINDS)
    rows = spans.select(F.xxhash64("text").alias("h"), F.explode(F.array(*chosen)).alias("c")).filter("size(c.parts) > 0")
    parts = rows.select("h", "c.kind", F.explode("c.parts").alias("part"))
    first = Window.partitionBy("kind").orderBy("h", "part")
    parts = parts.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample).orderBy("h", "kind", "place")
    return train([r["part"] for r in parts.select("part", "h", "kind", "place").collect()])


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of text within half a window of a digit or an @."""
    out: list[list[int]] = []
    for m in MARKED_RUN.finditer(text):
        s, e = max(0, m.start() - STEP), min(len(text), m.end() + STEP)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _plausible(kind: str, text: str) -> bool:
    """Whether a span passes its kind's test, as the base spans do."""
    digits = _digits(text)
    if kind == "email":
        return text.count("@") == 1 and not text.startswith("@") and not text.endswith("@")
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def reconciled(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, room to the window's nearer edge) that overlap, whatever their kinds, the deepest, then the first."""
    kept: list[tuple[int, int, int]] = []
    for kind, s, e, _ in sorted(found, key=lambda f: (-f[3], f[1], f[2], f[0])):
        if all(e <= a or s >= b for _, a, b in kept):
            kept.append((kind, s, e))
    return kept


def added_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans (kind number, start, end) that the network finds in each text."""
    windows, owners = [], []
    for i, text in enumerate(texts):
        for s, e in stretches(text):
            for begin in range(s, max(s + 1, e - STEP), STEP):
                windows.append(text[begin : min(e, begin + WINDOW)])
                owners.append((i, begin))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for j in range(0, len(windows), 512):
        some = windows[j : j + 512]
        x = np.zeros((len(some), WINDOW), np.int64)
        for r, w in enumerate(some):
            x[r, : len(w)] = encoded(w)
        tags, sure = tagger.decode(x)
        for r in np.flatnonzero((tags > 0).any(1)):
            i, begin = owners[j + r]
            n, row = len(some[r]), tags[r]
            at = 0
            while at < n:
                if not row[at]:
                    at += 1
                    continue
                kind, end = (row[at] - 1) // 2, at + 1
                while end < n and row[end] == 2 + 2 * kind:
                    end += 1
                whole = (at > 0 or begin == 0) and (end < n or begin + n == len(texts[i]))
                if whole and sure[r, at:end].min() >= LEAST_PROBABILITY and _plausible(KINDS[kind], some[r][at:end]):
                    found[i].append((int(kind), begin + at, begin + end, min(at, n - end)))
                at = end
    return [reconciled(f) for f in found]


def _find(batches: Iterable[pa.RecordBatch], tagger) -> Iterator[pa.RecordBatch]:
    tagger = tagger.value
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, tagger) if tagger else [[] for _ in texts]
            rows = []
            for own, more in zip(base, added):
                taken = [s for spans in own.values() for s in spans]
                more = [(k, s, e) for k, s, e in more if all(e <= a or s >= b for a, b in taken)]
                everything = {k: sorted(own[k] + [(s, e) for n, s, e in more if KINDS[n] == k]) for k in KINDS}
                rows.append((*(len(own[k]) for k in KINDS), hashlib.sha256(_listed(own).encode()).hexdigest(), _listed(everything)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans.

    Null and empty texts have none. Each row is judged alone, so repeated rows get the same spans and null doc_ids
    stay null; other columns are not read; an empty table gives no rows. Without a tagger the base spans are all.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_find, tagger=sent), schema)
