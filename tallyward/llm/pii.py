"""Personal data: pattern spans, and terms that give protected entities away.

Base spans (e-mail, IP, card and phone numbers) are protected entities. Corpus co-occurrence then says how strongly
a term reveals them. With c a kind of entity, or one entity's value, and t a word within ``window`` words of its
mentions:

    PMI(c; t) = ln(p(c | t) / p(c)),  IC(c) = -ln p(c),  disclosure = PMI / IC

where p(c | t) is the share of t's occurrences in the corpus that stand near c and p(c) the share of all words, both
over every occurrence, copies included. Any word outside the protected entities may be a term, numbers and names with
digits too. A term is taken when its disclosure reaches ``threshold`` and it stands near at least ``support`` different values of
the kind (it is generalised to that kind), or near one value in at least ``support`` different surroundings (it is removed).
For that support equal surroundings count once, so copies of a document prove nothing.

Three passes over the texts: surroundings of entities; counts of the words that occur in enough of them; spans.
Candidate words are counted through a bit table of fixed size, so no pass shuffles a text or a vocabulary.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts, staged, texts

KINDS = ["email", "ip", "card", "phone"]
# Fixed patterns; the local part of an address is found from its @, so that long runs without one cost nothing.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\w+")
BITS = 1 << 20
#: Revealing terms handed to a task at once; more terms go through further map steps of the same stage.
TERMS_AT_ONCE = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


def surroundings(text: str, spans: list[tuple[str, int, int]], window: int) -> list[list[tuple[int, str]]]:
    """For each span the words near it, lower-cased and with their number in the text. Words that overlap a span, its own or
    another's, are left out, but count as words on the way."""
    found = [m.span() for m in WORD.finditer(text)]
    starts, ends = [s for s, _ in found], [e for _, e in found]
    covered = bytearray(len(found))
    sides = []
    for _, start, end in spans:
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        covered[left:right] = b"\1" * (right - left)
        sides.append((left, right))
    return [[(i, text[starts[i]:ends[i]].lower())
             for i in (*range(max(0, left - window), left), *range(max(left, right), min(right + window, len(found))))
             if not covered[i]] for left, right in sides]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def entity_contexts(source: DataFrame, window: int) -> DataFrame:
    """(kind, value, context, term, near, near_kind) of every entity mention; values and contexts as 64-bit digests.

    ``near`` counts the occurrences of the term that stand near the mention and near no earlier one of the same value in
    the text, ``near_kind`` those near no earlier one of the same kind; the row with a null term counts all words so.
    """

    def collect(blocks) -> Iterator[dict]:
        for _, block in blocks:
            out: dict[str, list] = {"kind": [], "value": [], "context": [], "term": [], "near": [], "near_kind": []}
            for t in block:
                spans = base_spans(t)
                if not spans:
                    continue
                seen: dict[str | int, set[int]] = {}
                for (kind, start, end), around in zip(spans, surroundings(t, spans, window)):
                    value, context = digest(f"{kind}:{t[start:end]}"), digest(" ".join(w for _, w in around))
                    of_value, of_kind = seen.setdefault(value, set()), seen.setdefault(kind, set())
                    rows: dict[str | None, list[int]] = {None: [0, 0]}
                    for i, w in around:
                        for row in (rows[None], rows.setdefault(w, [0, 0])):
                            row[0] += i not in of_value
                            row[1] += i not in of_kind
                        of_value.add(i)
                        of_kind.add(i)
                    for w, row in rows.items():
                        for k, x in zip(out, (kind, value, context, w, *row)):
                            out[k].append(x)
            yield out

    return map_texts(source, collect, "kind string, value long, context long, term string, near long, near_kind long")


def word_counts(source: DataFrame, bits: bytes) -> DataFrame:
    """(term, n) of all words whose bit is set; the row with a null term counts all words."""
    shared = source.sparkSession.sparkContext.broadcast(bits)

    def count(blocks) -> Iterator[dict]:
        table, known = shared.value, {}
        seen: dict[str, int] = {}
        total = 0
        for _, block in blocks:
            for t in block:
                tokens = WORD.findall(t.lower())
                total += len(tokens)
                for w in tokens:
                    hit = known.get(w)
                    if hit is None:
                        p = digest(w) % BITS
                        hit = known[w] = bool(table[p >> 3] >> (p & 7) & 1)
                    if hit:
                        seen[w] = seen.get(w, 0) + 1
            if len(known) > 400_000:
                known = {}
            if len(seen) > 300_000:
                yield {"term": list(seen), "n": list(seen.values())}
                seen = {}
        yield {"term": [*seen, None], "n": [*seen.values(), total]}

    return map_texts(source, count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing_terms(source: DataFrame, threshold: float, support: int, window: int) -> DataFrame:
    """(term, action, disclosure): action ``remove``, or ``generalise_<kind>`` with the kind that the term reveals most (of equals
    the first by name)."""
    spark = source.sparkSession
    contexts = staged(entity_contexts(source, window).groupBy("kind", "value", "context", "term").agg(
        F.sum("near").alias("near"), F.sum("near_kind").alias("near_kind")), "contexts")
    named = contexts.filter("term is not null")
    by_kind = named.groupBy("kind", "term", "value").agg(F.sum("near_kind").alias("n")).groupBy("kind", "term").agg(
        F.count(F.lit(1)).alias("support"), F.sum("n").alias("near")).withColumn("value", F.lit(None).cast("long"))
    by_value = named.groupBy("kind", "value", "term").agg(
        F.count(F.lit(1)).alias("support"), F.sum("near").alias("near"))
    candidates = staged(by_kind.unionByName(by_value).filter(F.col("support") >= support), "candidates")

    def place(blocks) -> Iterator[dict]:
        for (terms,) in blocks:
            yield {"place": [digest(w) % BITS for w in terms]}

    places = map_texts(candidates.select("term").distinct(), place, "place long", text_at=0).distinct().collect()
    bits = np.zeros(BITS, np.uint8)
    bits[[r["place"] for r in places]] = 1
    counts = staged(word_counts(source, np.packbits(bits, bitorder="little").tobytes()), "words")
    total = F.lit(max((counts.filter("term is null").first() or {"n": 0})["n"] or 0, 2))
    every = contexts.filter("term is null")
    kinds = every.groupBy("kind").agg(F.sum("near_kind").alias("words"))
    values = every.groupBy("kind", "value").agg(F.sum("near").alias("words"))
    sized = candidates.filter("value is null").join(kinds, "kind").unionByName(
        candidates.filter("value is not null").join(values, ["kind", "value"]))
    # share of all words that stand near the entity
    share = F.least(F.col("words") / total, F.lit(0.5))
    given = F.least(F.col("near") / F.col("n"), F.lit(1.0))
    scored = sized.join(counts, "term").withColumn("disclosure", F.log(given / share) / -F.log(share)) \
        .filter(F.col("disclosure") >= threshold)
    return scored.groupBy("term").agg(
        F.max("disclosure").alias("disclosure"), F.max(F.col("value").isNotNull()).alias("one"),
        F.min(F.struct(-F.col("disclosure"), "kind")).alias("most")).select(
        "term", F.when(F.col("one"), "remove").otherwise(F.concat(F.lit("generalise_"), "most.kind")).alias("action"), "disclosure")


def term_spans(text: str, terms: dict[str, str]) -> list[tuple[str, int, int]]:
    if not terms or terms.keys().isdisjoint(WORD.findall(text.lower())):
        return []
    return [(terms[m.group().lower()], *m.span()) for m in WORD.finditer(text) if m.group().lower() in terms]


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with spans replaced: base spans by their kind, generalised terms by the kind they reveal, removed terms by nothing. Of
    overlapping spans the one that starts first, then the longer one, is replaced."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], "" if kind == "remove" else f"[{kind.removeprefix('generalise_').upper()}]"]
            at = end
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75,
                       support: int = 4, window: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text, spans (array of kind, start, end; base kinds in the order of ``KINDS``, then
    ``generalise_<kind>`` and ``remove``, each by start), clean_text, and the columns named in ``keep``.

    Positions are code points, end exclusive. A null text counts as empty and a null id stays null; repeated rows
    get a row each; other columns are ignored unless kept (a kept column must not have one of the names above);
    an empty table gives an empty result. Texts are read whole.
    """
    source = texts(docs, id_col, text_col)
    flagged = staged(revealing_terms(source, threshold, support, window), "terms")
    blocks = max(1, -(-flagged.count() // TERMS_AT_ONCE))
    wide = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *[F.col(f"`{c}`") for c in keep])
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in wide.schema[2:]) if keep else ""
    kind = wide.schema["doc_id"].dataType.simpleString()
    span_type = "array<struct<kind:string,start:int,end:int>>"
    out = wide
    for k in range(blocks):
        part = flagged.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).select("term", "action").collect()
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["action"] for r in part})

        def mark(batch, shared=shared, first=k == 0, last=k == blocks - 1) -> Iterator[dict]:
            terms = shared.value
            for cols in batch:
                ids, block, *rest = cols
                before = [base_spans(t) for t in block] if first else [
                    [(s["kind"], s["start"], s["end"]) for s in x] for x in rest.pop()]
                spans = []
                for t, base in zip(block, before):
                    covered = [s for s in base if s[0] in KINDS]
                    extra = [x for x in term_spans(t, terms)
                             if not any(x[1] < e and s < x[2] for _, s, e in covered)]
                    spans.append(covered + sorted([s for s in base if s[0] not in KINDS] + extra))
                named = dict(zip(keep, rest))
                made = {"doc_id": ids, "text": block, **named,
                        "spans": [[{"kind": a, "start": s, "end": e} for a, s, e in x] for x in spans]}
                if last:
                    made["clean_text"] = [sanitised(t, x) for t, x in zip(block, spans)]
                yield made

        out = map_texts(out, mark, f"doc_id {kind}, text string{kept}, spans {span_type}"
                        + ", clean_text string" * (k == blocks - 1))
    return out


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as one string."""
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")  # noqa: E731,E501
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(join(of(*KINDS)), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
