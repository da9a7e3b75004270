"""Secret scans: candidates by their characters, false positives removed by a random forest.

A candidate is what stands after a word that speaks for a secret and ``=`` or ``:``, of any length and any characters up
to white space or the closing quote; and, besides those, every run of ``A-Z a-z 0-9 + / _ - .``: any of at least 12, any
of at least 6 with both letters and digits, and any of at least 4 within 40 bytes of a word that speaks for a secret. The
forest looks at its length, at transitions between kinds of characters, at how much of it dictionary words cover, at
traits of paths and at the words on both sides of it. It is trained on labelled findings: pieces of text with one finding
each, and whether that is a secret. Callers pass their own; by default findings are made from forms that secrets and
look-alikes take, as no table holds labelled ones.

Scale: one pass over the texts without a shuffle; candidates are found in numpy and by one pattern over the bytes of a
batch, and only they are looked at one by one. The forest has a bounded size.

Cases: a null text is like an empty one (no candidates, redacted to an empty text when scanned, kept null with
``carry``); very long texts are read whole, in arrays of some 40 bytes a character; overlapping findings cannot occur;
ties at the threshold count as secrets; repeated rows are scanned each; an empty table gives an empty result; columns
other than doc_id and text are not looked at, and come along with ``carry``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2
from operator import eq, ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm import forest
from fathomline.llm.common import LOWER, chunks

#: Least length of a run by itself, of one with both letters and digits, and of one near a word that speaks for a secret.
MIN_LENGTH, MIN_MIXED, MIN_NEAR = 12, 6, 4
SECRET_FROM = 0.6
MARK = b"[SECRET]"
RUN = np.zeros(256, bool)
RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.")] = True
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: Kinds of characters: digits, small letters, capitals, all others; and those that are no odd signs in a value.
KIND_TABLE = bytes(0 if c in b"0123456789" else 1 if c in b"abcdefghijklmnopqrstuvwxyz" else 2 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 3 for c in range(256))
PLAIN_SIGNS = bytes(c for c in range(256) if c in b"+/_-." or chr(c).isalnum())
HEX = re.compile(rb"[0-9a-fA-F]+")
#: Words that speak for a secret, or for a look-alike, beside a candidate; and words found in readable names.
FOR = re.compile(rb"(?i)secret|passw|passphrase|pwd|\bpin\b|token|api.?key|access.?key|private.?key|auth|bearer|credential|\bkey\b")
AGAINST = re.compile(rb"(?i)sha\d*|md5|crc|checksum|digest|commit|revision|uuid|guid|hash|version|order|phone|isbn|build|example|sample|invoice|serial|file|path|host|mail")
#: What is given as a secret's value: up to a quote or white space, or up to the quote it began with.
GIVEN = re.compile(rb"""(?i)(?:secret|passw(?:or)?d|passw|passphrase|pwd|token|api.?key|access.?key|private.?key|credential|\bkey\b|\bpin\b)[\w.\-]{0,30}["']?[ \t]{0,3}(?:=>|:=|==?|:)[ \t]{0,3}(?:"([^"\s]+)"|'([^'\s]+)'|["']?([^\s"']+))""")
#: The first three letters of all that FOR and GIVEN begin with.
STARTS = np.array([int.from_bytes(x, "big") for x in b"sec pas pwd pin tok api acc pri aut bea cre key".split()])
CHOSEN = re.compile(rb"(?i)secret|passw|passphrase|pwd")
PUNCTUATION = b".,;:!?)]}>"
DICTIONARY = tuple(b"about access admin agent alpha api app archive asset auto base beta bin build cache change client cloud code common config content core create data date default demo device disk docs document download driver dummy error event example export file filter final format frame free global group guide header home host html http image import index info input install item java json kernel label language lib library license linux list load local logs mail main manager map master media menu message meta model module month name network node note number object office online order output package page panel part patch path photo place plain plugin print private product profile project public python query readme record release remote report request resource response result sample script search section secure server service session setting share simple site size source stable stage start state static status storage store stream string style support system table target task template test text theme thread time tmp token tool train tree type update upload user usr util value version video view volume web week window word work year".split())
FEATURES = 26
#: How keys of known services begin.
ISSUED = re.compile(rb"AKIA[A-Z0-9]{8}|gh[pousr]_|sk-|xox[abpr]-|glpat-")
TAIL = re.compile(rb"\.[a-z]{1,5}[0-9]?$")
NEAR = 40


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the candidates, and the first candidate's index of each text."""
    inside = RUN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    some = ends - starts >= MIN_NEAR
    starts, ends = starts[some], ends[some]
    named, values = spoken(data, offsets)
    digits, letters = (np.concatenate([[0], np.cumsum(x[data])]) for x in (DIGIT, LETTER))
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    length = ends - starts
    use = (length >= MIN_LENGTH) | (mixed & (length >= MIN_MIXED)) | near_words(named, offsets, starts, ends)
    starts, ends = starts[use], ends[use]
    at, until = values
    if len(at):  # what is given as a value is one candidate, runs within it are none
        place = np.minimum(np.searchsorted(until, starts, side="right"), len(at) - 1)
        free = ~((at[place] < ends) & (until[place] > starts))
        starts, ends = np.concatenate([starts[free], at]), np.concatenate([ends[free], until])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offsets)


def spoken(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that speak for a secret, and of the values given for them (unquoted ones without
    final punctuation)."""
    words, values = [], []
    low = LOWER[data].astype(np.int32)
    three = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
    spots = np.flatnonzero(np.isin(three, STARTS))  # no pattern begins elsewhere
    first = np.searchsorted(spots, offsets).tolist()
    for i in np.flatnonzero(np.diff(first)).tolist():
        lo, text = int(offsets[i]), data[offsets[i] : offsets[i + 1]].tobytes()
        end = done = last = 0
        for at in (spots[first[i] : first[i + 1]] - lo).tolist():
            if at >= end and (m := FOR.match(text, at)):
                words.append((lo + at, lo + m.end()))
                end = m.end()
            if at >= done and (m := GIVEN.match(text, at)):
                done = m.end()
                a, b = m.span(m.lastindex)
                if m.lastindex == 3:
                    b = a + len(text[a:b].rstrip(PUNCTUATION))
                if last <= a < b:
                    values.append((lo + a, lo + b))
                    last = b
    return np.array(words, np.int64).reshape(-1, 2).T, np.array(values, np.int64).reshape(-1, 2).T


def near_words(words: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether one of the words lies in the same text within NEAR bytes before or after each run."""
    at, end = words
    if not len(at) or not len(starts):
        return np.zeros(len(starts), bool)
    text = np.searchsorted(offsets, starts, side="right") - 1
    before = np.searchsorted(end, starts, side="right") > np.searchsorted(at, np.maximum(starts - NEAR, offsets[text]))
    after = np.searchsorted(end, np.minimum(ends + NEAR, offsets[text + 1]), side="right") > np.searchsorted(at, ends)
    return before | after


#: Dictionary words by their first three letters, the longest first: it covers what shorter ones at its place do.
BY_START: dict[bytes, list[bytes]] = {}
for _word in sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True):
    BY_START.setdefault(_word[:3], []).append(_word)


def covered(value: bytes) -> float:
    """The part of a value's characters that dictionary words cover."""
    low, total, done = value.lower(), 0, 0
    for at in range(len(low) - 2):
        for word in BY_START.get(low[at : at + 3], ()):
            if low.startswith(word, at):
                end = at + len(word)
                total += max(0, end - max(at, done))
                done = max(done, end)
                break
    return total / len(value)


def traits(value: bytes, left: bytes, right: bytes) -> list[float]:
    """FEATURES numbers of a candidate and what stands beside it."""
    n, kinds = len(value), value.translate(KIND_TABLE)
    p = [c / n for c in Counter(value).values()]
    pairs = max(1, n - 1)
    near = left[-NEAR:]
    last = b" ".join(re.findall(rb"[A-Za-z][A-Za-z_.-]*", near)[-2:])
    following = b" ".join(re.findall(rb"[A-Za-z][A-Za-z_.-]*", right[:NEAR])[:3])
    return [
        float(n), -sum(x * log2(x) for x in p), *(kinds.count(k) / n for k in range(4)), sum(map(ne, kinds, kinds[1:])) / pairs, float(bool(HEX.fullmatch(value))), covered(value),
        float(value.count(b"/")), float(value.count(b".")), float(bool(TAIL.search(value))), float(value[:1] in b"/."),
        float(bool(FOR.search(last))), float(bool(AGAINST.search(last))), float(bool(re.search(rb"[=:]\s*[\"']?$", near))), sum(map(eq, value, value[1:])) / pairs, float(value.count(b"-")),
        float(bool(FOR.search(following))), float(bool(AGAINST.search(following))), float(right[:1] in (b'"', b"'")), float(bool(ISSUED.match(value))),
        len(value.translate(None, PLAIN_SIGNS)) / n, float(bool(CHOSEN.search(last))), float(bool(re.search(rb"[=:][\"']?$", near))), float(left[-1:] in (b'"', b"'")),
    ]


def labelled_findings(n: int = 1500, seed: int = 7) -> list[tuple[bytes, int, int, bool]]:
    """(text, start, end, is a secret) of findings in the forms that secrets and their look-alikes take."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chars = lambda k, a: "".join(a[i] for i in rng.integers(0, len(a), k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    b64 = alnum + "+/"
    words = [w.decode() for w in DICTIONARY if len(w) > 3]
    word = lambda: pick(*words)
    syllables = lambda k: "".join(pick(*"bcdfghklmnprstvwz", "st", "sch", "tr", "") + pick(*"aeiou", "ei", "ou") + pick("", "", "n", "r", "s", "ng") for _ in range(k))
    signs = "!#$%&*@^~?"
    phrase = lambda: "".join(pick(word(), syllables(2)) for _ in range(rng.integers(2, 5)))
    names = ("token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private key", "passwd", "Bearer", "credential", "TOKEN", "KEY")
    out = []
    while len(out) < n:
        before, after = f"{word()} {word()} ", f" {word()} {word()}"
        secret = bool(rng.random() < 0.5)
        if secret:
            value = pick(lambda: chars(pick(24, 32, 40, 64), hexes), lambda: chars(pick(24, 32, 40, 64), hexes).upper(), lambda: chars(int(rng.integers(16, 48)), alnum), lambda: chars(int(rng.integers(8, 16)), alnum), lambda: chars(int(rng.integers(20, 64)), b64), lambda: "AKIA" + chars(16, pick(alnum[:26], alnum[:26] + alnum[52:])), lambda: chars(int(rng.integers(12, 24)), alnum[:52]), lambda: pick("ghp_", "sk-", "xoxb-", "glpat-") + chars(32, alnum), lambda: chars(int(rng.integers(8, 24)), alnum + signs), lambda: chars(int(rng.integers(6, 20)), alnum + signs), phrase, lambda: pick(syllables(2), word()) + chars(int(rng.integers(1, 5)), "0123456789") + pick("", "", "!", "#"))()
            name = pick(*names)
            weak = value.isalpha() and value.islower() or len(value) < 12 and value[:1].isalpha() and not any(c.isdigit() for c in value[1:-3])
            weak = weak or not any(c in alnum[:26] for c in value) and value.rstrip("!#0123456789").isalpha()
            form = pick('{} = "', "{}=", '{}="', "{} = '", '{}: "') if weak else pick('{} = "', "{}=", "{}: ", "{} = '", "{} ", '{}:"')
            if weak:  # only what is given as a value can be told from prose
                name = pick("password", "passwd", "secret", "pwd", "passphrase", "db_password", "client_secret", "PASSWORD")
            if not value.isalnum() and any(c in signs for c in value) and form == "{} ":
                form = "{}: "
            if rng.random() < 0.1 and value[:4] in ("AKIA", "ghp_", "xoxb", "glpa"):
                name = word()
            lead = before + form.format(name)
            if rng.random() < 0.1:
                lead, after = before, pick(" is the ", " as ", " (", " is my ") + pick(*names) + after
        else:
            kind = int(rng.integers(15))
            value = [
                lambda: chars(pick(32, 40, 64), hexes),
                lambda: "-".join(chars(k, hexes) for k in (8, 4, 4, 4, 12)),
                lambda: "/" + "/".join(word() for _ in range(rng.integers(2, 5))) + f"{rng.integers(1, 30)}/{word()}{rng.integers(1, 99)}.{pick('py', 'txt', 'html', 'so', 'c')}",
                lambda: f"{word()}-{word()}-{rng.integers(1, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 99)}-{pick('rc1', 'beta2', 'x86_64')}",
                lambda: chars(int(rng.integers(12, 20)), "0123456789"),
                lambda: f"{word()}.{rng.integers(1, 99)}.{pick('mail', 'www', 'cdn')}{rng.integers(1, 9)}.example.com",
                lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}.{rng.integers(10, 60)}.{rng.integers(10, 60)}",
                lambda: pick("EXAMPLE_", "YOUR_", "xxxxxxxx", "changeme_", "placeholder-", "dummy_") + word() + pick("_1234", "-0000", "_12345678"),
                lambda: "_".join(word() for _ in range(3)) + f"_{rng.integers(10, 999)}",
                lambda: f"{rng.integers(10, 99)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}",
                lambda: pick(str, str.capitalize, str.upper, str.upper)(syllables(int(rng.integers(2, 9)))) + pick("", "", "."),
                lambda: pick(str, str.capitalize, str.upper)(word() + pick("", "s", "ing", "ed")) + pick("", "", "."),
                lambda: pick("-", "_", ".", "/").join(pick(syllables(2), word()) for _ in range(rng.integers(2, 4))),
                lambda: "".join(word().capitalize() for _ in range(rng.integers(2, 4))),
                lambda: pick(word(), syllables(2)) + pick("", "-", "_", "v") + str(rng.integers(1, 2030)),
            ][kind]()
            if kind < 2:
                lead = before + pick("sha1: ", "sha256=", "commit ", "md5: ", "checksum ", "uuid ", "digest = ", "revision ", "build id: ", "hash: ", 'uuid="', "serial ")
            elif kind >= 10:
                lead = before + pick("", "", "the ", "a ", pick(*names) + " ", pick(*names) + " is ", pick(*names) + ": ", pick(*names) + ": ", pick("token", "key", "auth") + "=")
                after = pick("", "", " " + pick(*names)) + after
            elif kind in (7, 8):
                lead = before + pick("token = ", "password=", 'api_key: "', "file ", "")
            else:
                lead = before + pick("", "", "file ", "see ", "path=", "order ", "phone: ", "version ", "host ", "id: ")
        if len(value) < MIN_NEAR:
            continue
        text = (lead + value + pick('"', " ", "", "'") + after).encode()
        out.append((text, len(lead.encode()), len(lead.encode()) + len(value), secret))
    return out


def train(findings: list[tuple[bytes, int, int, bool]] | None = None) -> list[dict]:
    rows = findings if findings is not None else labelled_findings()
    x = np.array([traits(t[a:b], t[max(0, a - 2 * NEAR) : a], t[b : b + NEAR]) for t, a, b, _ in rows])
    return forest.fit(x, np.array([float(s) for *_, s in rows]))


def find(model: list[dict], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and scores of all candidates, and the first one's index of each text."""
    starts, ends, first = candidates(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0), first
    raw, own = data.tobytes(), np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    begin, end = offsets[own], offsets[own + 1]
    x = np.array([traits(raw[a:b], raw[max(lo, a - 2 * NEAR) : a], raw[b : min(hi, b + NEAR)]) for a, b, lo, hi in zip(starts.tolist(), ends.tolist(), begin.tolist(), end.tolist(), strict=True)])
    return starts, ends, forest.predict(model, x), first


def scan(docs: DataFrame, findings=None, secret_from: float = SECRET_FROM, carry: bool = False) -> DataFrame:
    """doc_id, n_candidates, findings (start and end in code points, score) and redacted text of every row.

    With ``carry`` the rows come as they are, but for ``text``, in which secrets are replaced (a null text stays null).
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(findings))
    source = docs if carry else docs.select("doc_id", "text")
    column = source.columns.index("text")
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_candidates long, findings array<struct<start:long,end:long,score:double>>, redacted string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(column)):
                starts, ends, score, first = find(shared.value, data, offsets)
                raw, texts, found = data.tobytes(), [], []
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    at, parts, here = lo, [], []
                    for k in range(first[i], first[i + 1]):
                        if score[k] >= secret_from:
                            s, e = int(starts[k]), int(ends[k])
                            here.append({"start": int(point[s] - point[lo]), "end": int(point[e] - point[lo]), "score": float(score[k])})
                            parts += [raw[at:s], MARK]
                            at = e
                    texts.append(b"".join([*parts, raw[at:hi]]).decode())
                    found.append(here)
                rows = batch.slice(a, b - a)
                if carry:
                    valid = rows.column(column).is_valid().to_numpy(zero_copy_only=False)
                    new = pa.array([t if v else None for t, v in zip(texts, valid.tolist(), strict=True)], rows.schema.field(column).type)
                    yield rows.set_column(column, rows.schema.field(column).name, new)
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(found, kind), pa.array(texts)], names=["doc_id", "n_candidates", "findings", "redacted"])

    return source.mapInArrow(run, docs.schema if carry else fields)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, the first secret's start (null if none) and a checksum of the redacted text."""
    from pyspark.sql import functions as F

    return scanned.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), F.get("findings", F.lit(0))["start"].alias("first_start"), F.sha2("redacted", 256).alias("redacted_sha256"))
