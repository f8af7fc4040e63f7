"""Personal data by anchors: an Aho-Corasick automaton finds cues, local parsers expand and validate what stands around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids

ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DIGITS = frozenset("0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIALLED = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\r\v\f\"'<>|\\^`{}")
BASE_KINDS, ADDED_KINDS = ("email", "ip", "card", "phone"), ("url", "iban", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account number", "account no", "account", "acct", "customer id", "ssn", "passport", "tax id")

Span = tuple[int, int]


def run_end(text: str, at: int, allowed: frozenset) -> int:
    """Where the run of allowed characters that starts at `at` ends."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def parse_email(text: str, at: int, since: int) -> Span | None:
    """`local@label(.label)+` around the at-sign at `at`; the local part starts no earlier than `since`."""
    start = at
    while start > since and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and text[end + 1 : end + 2] in LABEL and end + 1 < len(text):
        end, labels = run_end(text, end + 1, LABEL), labels + 1
    return (start, end) if labels > 1 else None


def parse_ip(text: str, at: int, since: int) -> tuple[Span, bool] | None:
    """Four dotted runs of digits from the digit at `at`, and whether each is at most 255."""
    end, parts = run_end(text, at, DIGITS), 1
    values = [text[at:end]]
    while parts < 4 and text[end : end + 1] == "." and text[end + 1 : end + 2] in DIGITS and end + 1 < len(text):
        begin, end = end + 1, run_end(text, end + 1, DIGITS)
        values.append(text[begin:end])
        parts += 1
    if parts < 4:
        return None
    return (at, end), all(len(v.lstrip("0")) < 4 and int(v) <= 255 for v in values)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def parse_card(text: str, at: int, since: int) -> tuple[Span, bool] | None:
    """Digits with at most one space or hyphen between two, from the digit at `at`; valid with 13 to 19 that pass the Luhn sum."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = text[at:end].replace(" ", "").replace("-", "")
    return (at, end), 13 <= len(digits) <= 19 and luhn(digits)


def parse_phone(text: str, at: int, since: int) -> tuple[Span, bool] | None:
    """A plus sign, a digit, and up to the last digit of the run of dialling characters; valid with 9 to 15 digits."""
    if text[at + 1 : at + 2] not in DIGITS or at + 1 >= len(text):
        return None
    end = run_end(text, at + 2, DIALLED)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return (at, end), 9 <= sum(c in DIGITS for c in text[at:end]) <= 15


def parse_url(text: str, at: int, cue: int, since: int) -> Span | None:
    """A scheme and what follows up to a space, quote or bracket, without closing punctuation; it needs a host or mailbox."""
    if text[at - 1 : at] in ALNUM or text[cue : cue + 1] not in ALNUM:
        return None
    end = cue
    while end < len(text) and text[end] not in URL_END:
        end += 1
    while end > cue and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (at, end) if end > cue else None


def parse_iban(text: str, at: int, since: int) -> Span | None:
    """Two capitals, two check digits and 11 to 30 capitals or digits, in groups or not, whose remainder by 97 is 1; from `at`."""
    if at > 0 and text[at - 1] in ALNUM:
        return None
    end, code = at, ""
    while end < len(text) and len(code) < 34:
        if text[end] in ALNUM and not text[end].islower():
            code, end = code + text[end], end + 1
        elif text[end] == " " and text[end + 1 : end + 2] in ALNUM and not text[end + 1 : end + 2].islower() and len(code) % 4 == 0 and code:
            end += 1
        else:
            break
    while len(code) >= 15:
        if code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 and (end >= len(text) or text[end] not in ALNUM):
            return at, end
        cut = text.rfind(" ", at, end)
        if cut < 0:
            return None
        end = cut
        code = text[at:end].replace(" ", "")
    return None


def parse_account(text: str, at: int, cue: int, since: int) -> Span | None:
    """The number after a cue word: at most 4 of space, colon, hash, dot or equals sign, then 6 to 34 of letters, digits and hyphens with 6 digits or more."""
    if at > 0 and text[at - 1] in ALNUM:
        return None
    start = cue
    while start < len(text) and start < cue + 4 and text[start] in " :#.=":
        start += 1
    end = run_end(text, start, LABEL)
    number = text[start:end].rstrip("-")
    end = start + len(number)
    return (start, end) if start > cue and 6 <= len(number) <= 34 and number[0] != "-" and sum(c in DIGITS for c in number) >= 6 else None


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> dict[str, list[Span]]:
    """The spans of each kind in `text`, in code points, end exclusive.

    Base kinds are the leftmost non-overlapping ones of their pattern: a match that fails its check is passed over whole.
    """
    spans: dict[str, list[Span]] = {k: [] for k in BASE_KINDS + ADDED_KINDS}
    if not text:
        return spans
    since = dict.fromkeys(spans, 0)

    def take(kind: str, found: Span | tuple[Span, bool] | None) -> None:
        if found is not None:
            span, valid = found if isinstance(found[0], tuple) else (found, True)
            since[kind] = span[1]
            if valid:
                spans[kind].append(span)

    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            # a run of digits is one anchor, from its first digit on
            run = at > 0 and text[at - 1] in DIGITS
            for base, parse in (("ip", parse_ip), ("card", parse_card)):
                if at >= since[base] and (not run or at == since[base]):
                    take(base, parse(text, at, since[base]))
            if not run and at >= 2 and at >= since["iban"] + 2 and text[at - 2] in ALNUM and text[at - 1] in ALNUM:
                take("iban", parse_iban(text, at - 2, since["iban"]))
        elif kind == "email":
            take("email", parse_email(text, at, since["email"]))
        elif kind == "phone":
            if at >= since["phone"]:
                take("phone", parse_phone(text, at, since["phone"]))
        elif at >= since[kind]:
            parse: Callable = parse_url if kind == "url" else parse_account
            take(kind, parse(text, at, last + 1, since[kind]))
    return spans


def joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id`, counts of the base kinds, `base_sha256`, `spans`, and counts of the added kinds.

    Base kinds are email, ip, card and phone; added are url, iban and account (a number after a cue word). `spans` lists
    kind:start:end by kind, then start; `base_sha256` is the SHA-256 of the base part of it.

    Null counts as the empty text, which has no spans. Whole texts are read, in time linear in their length. Repeated rows
    each get their row, other columns are ignored, an empty table gives no rows.
    """
    counts = [f"n_{k}" for k in BASE_KINDS + ADDED_KINDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = find_spans(text)
                base = joined(spans, BASE_KINDS)
                rows.append((hashlib.sha256(base.encode()).hexdigest(), ",".join(filter(None, (base, joined(spans, ADDED_KINDS)))), *(len(spans[k]) for k in BASE_KINDS + ADDED_KINDS)))
            out = pd.DataFrame(rows, columns=["base_sha256", "spans", *counts])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, base_sha256 string, spans string, " + ", ".join(f"{c} long" for c in counts)
    ))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each span in `text_col` replaced by its kind in square brackets; of overlapping spans the first, then longest, counts."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text:
                return text
            spans = sorted(((a, -b, k) for k, found in find_spans(text).items() for a, b in found))
            out, at = [], 0
            for a, b, kind in spans:
                if a >= at:
                    out += [text[at:a], f"[{kind}]"]
                    at = -b
            return "".join(out) + text[at:]

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))
