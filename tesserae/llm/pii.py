"""Personal data and secrets: a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.text import buffers

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "IBAN", "SSN", "SECRET")
MOST_TOKENS, MOST_CHARS = 24, 160
SCHEMA = "doc_id long, text string, entities array<struct<type:string,start:int,end:int>>"
_TRIGGER = np.zeros(256, bool)
for _c in b"0123456789@=":
    _TRIGGER[_c] = True
_MARKS = re.compile("[0-9@=:_-]")
_TOKEN = re.compile(r"[^\W_]+|\S")
_OPENS, _CLOSES = set('+("\''), set(')"\'')
_CONTINUES = set('(+-="\':') | set("0123456789")
_KEY = r"(?:pass(?:word|wd)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|key|credential)"
_PREFIX = r"(?:sk|pk|ghp|gho|xox[bp])"
#: Of a text without a digit, @ or =, what makes it worth a look; in the regular expressions of Python, Arrow and Java alike.
_WORDED = rf"(?i:{_KEY}) ?:|{_PREFIX}[-_]"
_KEY_ENDS = re.compile(rf"(?i:{_KEY}) ?$")
_PREFIX_ENDS = re.compile(rf"{_PREFIX}$")
#: An unbroken stretch counts as one segment, however long; so does its assignment to a key.
_LONG = re.compile(r"[\w.+/~-]{64,}={0,2}")
_LONG_KEY = re.compile(rf"(?<![^\W_])(?i:{_KEY}) ?[=:] ?([\"']?)$")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(text: str) -> bool:
    t = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


_SHAPES = [
    ("email", re.compile(r"[\w.+%-]*[\w+%-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("ip", re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")),
    ("dotted", re.compile(r"\d+(?:\.\d+)+")),
    ("phone_plus", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}")),
    ("phone_area", re.compile(r"\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}")),
    ("phone_plain", re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}")),
    ("card", re.compile(r"[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}")),
    ("iban", re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}")),
    ("aws", re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")),
    ("hex32", re.compile(r"[0-9a-fA-F]{32,}")),
    ("prefix_key", re.compile(r"(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{12,}")),
    ("assigned", re.compile(rf"(?i:{_KEY})\s*[=:]\s*(?:\"[^\"\s]{{4,}}\"|'[^'\s]{{4,}}'|[^\s\"'.,;!?*%&$#|<>()\[\]{{}}]{{4,}})")),
    ("assigned_open", re.compile(rf"(?i:{_KEY})\s*[=:].*")),
    ("date", re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}")),
    ("number", re.compile(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[+-]?\d+(?:\.\d+)?")),
]
FEATURES = [n for n, _ in _SHAPES] + ["card_luhn", "iban_sum", "spaced", "one_token", "digits_few", "digits_7_12", "digits_13_19", "digits_more", "mixed_long", "glued_left", "glued_right", "quoted", "keyed_left", "goes_on", "came_on", "opens", "at_sign", "equals", "no_shape", "bias"]
_AT = {n: k for k, n in enumerate(FEATURES)}
_KEYED_LEFT = re.compile(rf"(?i){_KEY}\W{{0,4}}$")


def features(text: str, a: int, b: int) -> np.ndarray:
    """Statements about text[a:b] as a whole and about what it touches."""
    s = text[a:b]
    x = np.zeros(len(FEATURES))
    for k, (_, shape) in enumerate(_SHAPES):
        if shape.fullmatch(s):
            x[k] = 1
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    if x[_AT["card"]]:
        x[_AT["card_luhn"]] = _luhn(digits)
    if x[_AT["iban"]]:
        x[_AT["iban_sum"]] = _mod97(s)
    x[_AT["spaced"]] = " " in s
    x[_AT["one_token"]] = s.isalnum()
    x[_AT["digits_few"]], x[_AT["digits_7_12"]], x[_AT["digits_13_19"]], x[_AT["digits_more"]] = n < 7, 7 <= n <= 12, 13 <= n <= 19, n > 19
    x[_AT["mixed_long"]] = len(s) >= 16 and s.isalnum() and 0 < n < len(s)
    x[_AT["glued_left"]] = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "@._-+/" and a > 1 and text[a - 2].isalnum())
    x[_AT["glued_right"]] = b < len(text) and (text[b].isalnum() or text[b] in "@._-/" and b + 1 < len(text) and text[b + 1].isalnum())
    x[_AT["quoted"]] = s[0] in "\"'" or s[-1] in "\"'"
    x[_AT["keyed_left"]] = bool(_KEYED_LEFT.search(text[max(0, a - 24) : a]))
    x[_AT["goes_on"]] = text[b : b + 1] == " " and text[b + 1 : b + 2].isdigit()
    x[_AT["came_on"]] = a > 1 and text[a - 1] == " " and text[a - 2].isdigit()
    x[_AT["opens"]] = s[0] in "+("
    x[_AT["at_sign"]] = "@" in s
    x[_AT["equals"]] = "=" in s
    x[_AT["no_shape"]] = not x[: len(_SHAPES)].any()
    x[_AT["bias"]] = 1
    return x


def triggers(text: str, lo: int, hi: int) -> list[int]:
    """Places of digits, @ and =, of the colon after a key word, and of the dash after a key's prefix."""
    out = []
    for m in _MARKS.finditer(text, lo, hi):
        k, c = m.start(), m.group()
        if c == ":" and not _KEY_ENDS.search(text[max(0, k - 16) : k]) or c in "_-" and not _PREFIX_ENDS.search(text[max(0, k - 4) : k]):
            continue
        out.append(k)
    return out


def long_spans(text: str, lo: int, hi: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Of each long unbroken stretch, where it is with a key word before it, and by itself."""
    out = []
    for m in _LONG.finditer(text, lo, hi):
        a, b = m.span()
        key = _LONG_KEY.search(text[max(lo, a - 24) : a])
        begin, end = (a - len(key.group()), b + (key.group(1) != "" and text[b : b + 1] == key.group(1))) if key else (a, b)
        out.append(((begin, end), (a, b)))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text that hold every span of MOST_CHARS with a trigger, and every long one; there is no candidate elsewhere."""
    out: list[list[int]] = []
    around = [(k - MOST_CHARS, k + 1 + MOST_CHARS) for k in triggers(text, 0, len(text))]
    for a, b in sorted(around + [s for whole, bare in long_spans(text, 0, len(text)) for s in (whole, bare)]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(max(0, a), min(len(text), b)) for a, b in out]


def candidates(text: str, lo: int, hi: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of tokens of text[lo:hi], and the spans that may be entities: first token, token after the last, start, end.

    A span has a trigger, at most MOST_TOKENS tokens and MOST_CHARS characters, no white space but single blanks, and goes
    on after a blank only with what numbers, codes and assignments go on with. Beyond these bounds, a long unbroken stretch
    and its assignment to a key are spans.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    marks = triggers(text, lo, hi)
    hot = [bisect_left(marks, a) < bisect_left(marks, b) for a, b in tokens]
    upcoming = [0] * (len(tokens) + 1)
    upcoming[len(tokens)] = 1 << 30
    for i in range(len(tokens) - 1, -1, -1):
        upcoming[i] = i if hot[i] else upcoming[i + 1]
    found = []
    for i, (a, z) in enumerate(tokens):
        if upcoming[i] >= i + MOST_TOKENS or not (text[a].isalnum() or text[a] in _OPENS):
            continue
        if z - a > MOST_CHARS:
            continue
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            b, e = tokens[j]
            if e - a > MOST_CHARS:
                break
            if j > i and b > tokens[j - 1][1]:
                gap = text[tokens[j - 1][1] : b]
                if gap != " " or not (text[b] in _CONTINUES or text[b - 2] in ":=" or e - b <= 4 and text[b:e].isupper()):
                    break
            if upcoming[i] <= j and (text[e - 1].isalnum() or text[e - 1] in _CLOSES):
                found.append((i, j + 1, a, e))
    starts, ends = [a for a, _ in tokens], [e for _, e in tokens]
    for a, e in {span for both in long_spans(text, lo, hi) for span in both}:
        i, j = bisect_left(starts, a), bisect_left(ends, e)
        if i < len(tokens) and j < len(tokens) and starts[i] == a and ends[j] == e and (e - a > MOST_CHARS or j - i >= MOST_TOKENS) and upcoming[i] <= j:
            found.append((i, j + 1, a, e))
    return len(tokens), found


@dataclass
class Model:
    weights: np.ndarray  # (types, features)


def decode(model: Model, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    """The segmentation of highest score: tokens outside entities score 0, an entity its weighted features."""
    n, spans = candidates(text, lo, hi)
    if not spans:
        return []
    score = np.stack([features(text, a, e) for _, _, a, e in spans]) @ model.weights.T
    kind = score.argmax(1)
    ending: dict[int, list[int]] = {}
    for k, (_, j, _, _) in enumerate(spans):
        if score[k, kind[k]] > 0:
            ending.setdefault(j, []).append(k)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for t in range(1, n + 1):
        best[t], back[t] = best[t - 1], -1
        for k in ending.get(t, ()):
            v = best[spans[k][0]] + score[k, kind[k]]
            if v > best[t]:
                best[t], back[t] = v, k
    out, t = [], n
    while t > 0:
        if back[t] < 0:
            t -= 1
        else:
            i, _, a, e = spans[back[t]]
            out.append((TYPES[kind[back[t]]], a, e))
            t = i
    return out[::-1]


def find(model: Model, text: str) -> list[tuple[str, int, int]]:
    return [e for lo, hi in regions(text) for e in decode(model, text, lo, hi)]


def redacted(text: str, entities: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, e in entities:
        out += [text[at:a], f"[{kind}]"]
        at = e
    return "".join(out) + text[at:]


def _example(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence with entities, things that look like them, and where the entities are."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    low = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    up = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    mixed = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hexa = "0123456789abcdef"
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def luhn(n):
        x = rng.choice("3456") + d(n - 2)
        return next(x + c for c in "0123456789" if _luhn(x + c))

    def no_luhn():
        x = d(15)
        return next(x + c for c in rng.sample("0123456789", 10) if not _luhn(x + c))

    def iban():
        body, land = d(18), rng.choice(["DE", "FR", "ES", "GB"])
        number = next(f"{land}{k:02d}{body}" for k in range(2, 99) if _mod97(f"{land}{k:02d}{body}"))
        return number if rng.random() < 0.5 else " ".join(number[i : i + 4] for i in range(0, len(number), 4))

    word = lambda: rng.choice([low(rng.randint(1, 9)), low(4).title(), "é" + low(3), up(5)])
    key = lambda: rng.choice(["password", "token", "secret", "api_key", "Password", "TOKEN", "pwd", "key"])
    value = lambda: rng.choice([mixed(rng.randint(8, 40), hexa), mixed(rng.randint(8, 32), alnum), low(5) + d(3)])
    q = rng.choice(['"', '"', "'"])
    make = {
        "EMAIL": lambda: rng.choice([f"{low(5)}@{low(4)}.com", f"{low(3)}.{low(5)}@{low(6)}.example.org", f"{low(4)}.{d(2)}@mail{d(1)}.example.com", f"{low(3)}_{low(2)}+{low(2)}@{low(5)}.co.uk"]),
        "PHONE": lambda: rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)}{d(10)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(3)}"]),
        "IP": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "CARD": lambda: rng.choice([luhn(16), luhn(16), (lambda c: rng.choice(" -").join(c[i : i + 4] for i in (0, 4, 8, 12)))(luhn(16)), luhn(15)]),
        "IBAN": iban,
        "SSN": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "SECRET": lambda: rng.choice([f"{key()}={value()}", f"{key()} = {q}{value()}{q}", f"{key()}: {value()}", f"AKIA{mixed(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}", mixed(40, hexa), mixed(32, hexa), f"sk-{mixed(24, alnum)}", f"ghp_{mixed(24, alnum)}"]),
    }
    plain = [
        lambda: f"{rng.randint(1900, 2030)}", lambda: f"{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(2000, 2030)}",
        lambda: f"{d(1)}.{d(2)}", lambda: f"{rng.randint(1, 9)}.{d(1)}.{d(1)}", lambda: f"${rng.randint(1, 9)},{d(3)}.{d(2)}", lambda: d(rng.randint(1, 6)), lambda: d(8), no_luhn, no_luhn, lambda: d(13), lambda: f"{rng.randint(1, 23)}:{rng.randint(10, 59)}",
        lambda: f"@{low(6)}", lambda: f"{low(1)} = {d(1)}", lambda: f"{low(3)}={low(3)}", lambda: f"{rng.randint(10, 99)}%", lambda: f"{d(2)}-{d(2)}", lambda: f"({d(1)})", lambda: f"{low(4)}{d(2)}", lambda: f"{up(2)}-{d(3)}",
        lambda: mixed(7, hexa), lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"token {low(4)} {d(2)}", lambda: f"#{d(5)}", lambda: f"{d(2)} {d(3)}", lambda: f"+{d(1)}", lambda: f"version {d(1)}.{d(1)}.",
    ]
    text, spans = "", []
    noise = rng.choice(["", "", "", "!!", "###", "***", "&&&", "$$$", "%%%", ",", ".", " |"])
    for _ in range(rng.randint(3, 6)):
        text += " ".join(word() + noise for _ in range(rng.randint(1, 3))) + rng.choice([" ", " ", " ", "\n", ". ", ", ", " (", " <"])
        if rng.random() < 0.6:
            kind = rng.choice(TYPES)
            s = make[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = rng.choice(plain)()
        text += s + rng.choice([" ", " ", noise + " ", ". ", ", ", ") ", "\n", ">", "; "])
    return text + word(), spans


def loglik(weights: np.ndarray, n: int, spans: list, x: np.ndarray, gold: list[tuple[int, int]]) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold entities (span, type) and its gradient, by forward and backward sums over segmentations."""
    score = x @ weights.T
    total = np.logaddexp.reduce(score, axis=1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _, _) in enumerate(spans):
        ending[j].append(k)
        starting[i].append(k)
    fore, back = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        fore[t] = np.logaddexp.reduce([fore[t - 1], *[fore[spans[k][0]] + total[k] for k in ending[t]]])
    for t in range(n - 1, -1, -1):
        back[t] = np.logaddexp.reduce([back[t + 1], *[back[spans[k][1]] + total[k] for k in starting[t]]])
    z = fore[n]
    first, last = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    p = np.exp((fore[first] + back[last])[:, None] + score - z)
    gain = -p.T @ x
    value = -z
    for k, y in gold:
        value += score[k, y]
        gain[y] += x[k]
    return float(value), gain


@lru_cache(maxsize=4)
def trained(examples: int = 400, epochs: int = 14, seed: int = 7) -> Model:
    """The model fitted on made-up sentences; the same for the same arguments everywhere."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        text, entities = _example(rng)
        n, spans = candidates(text, 0, len(text))
        if not spans:
            continue
        at = {(a, e): k for k, (_, _, a, e) in enumerate(spans)}
        gold = [(at[a, e], TYPES.index(kind)) for kind, a, e in entities if (a, e) in at]
        data.append((n, spans, np.stack([features(text, a, e) for _, _, a, e in spans]), gold))
    w = np.zeros((len(TYPES), len(FEATURES)))
    w[:, _AT["bias"]] = -2
    seen = np.full_like(w, 1e-2)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, spans, x, gold in data:
            _, gain = loglik(w, n, spans, x, gold)
            gain -= 1e-3 * w
            seen += gain**2
            w += 0.5 * gain / np.sqrt(seen)
    return Model(w)


def cleaned(model: Model, col: pa.Array) -> tuple[pa.Array, dict[int, list[tuple[str, int, int]]]]:
    """A column of texts with their entities replaced, and the entities by row. Rows without a trigger aren't read one by one."""
    data, off = buffers(col)
    hit = np.unique(np.searchsorted(off, np.flatnonzero(_TRIGGER[data]), "right") - 1)
    hit = np.union1d(hit, np.flatnonzero(pc.match_substring_regex(col, _WORDED).fill_null(False).to_numpy(zero_copy_only=False)))
    entities: dict[int, list[tuple[str, int, int]]] = {}
    changed, at = [], 0
    for i in hit.tolist():
        text = col[i].as_py()
        found = find(model, text)
        if found:
            entities[i] = found
            changed += [col.slice(at, i - at), pa.array([redacted(text, found)], col.type)]
            at = i + 1
    return (pa.concat_arrays([*changed, col.slice(at)]) if changed else col), entities


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text, entities) of each row: the text with each entity replaced by its type in brackets, and where the
    entities were in the text given (in characters, the end excluded).

    Null text stays null and has no entities, as have empty texts. Texts are read whole. A null doc_id stays null;
    repeated rows are answered alike; other columns are ignored. No shuffle.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, found = cleaned(model, batch.column(1))
            entities = [[{"type": k, "start": a, "end": e} for k, a, e in found.get(i, [])] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(entities, kind)], ["doc_id", "text", "entities"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with the entities of their texts replaced by their types in brackets; where there is a column n_chars, it is the
    new text's length wherever the text changed. All other columns stay as they are, whatever their names.

    Null and empty texts stay. Rows are answered one by one, repeated ones alike; long texts are read whole; an empty table
    stays empty. No shuffle.
    """
    model = model or trained()

    columns = docs.columns
    ordered = docs.select("text", *[c for c in columns if c != "text"])
    counted = ordered.columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = cleaned(model, batch.column(0))
            if not found:
                yield batch
                continue
            arrays = [texts, *batch.columns[1:]]
            if counted is not None:
                new = np.zeros(batch.num_rows, bool)
                new[list(found)] = True
                arrays[counted] = pc.if_else(pa.array(new), pc.utf8_length(texts).cast(batch.column(counted).type), batch.column(counted))
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return ordered.mapInArrow(run, ordered.schema).select(*[F.col(f"`{c}`") for c in columns])
