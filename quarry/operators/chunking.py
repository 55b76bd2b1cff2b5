"""Chunking: by size, by packed units, by the structure of an act, and from HTML.

Structure is found with expressions over the array of a document's lines; the recursive size splitter and the merging of neighbours are Arrow functions
that hold a slice of a batch as Python objects at a time.
Pieces of a document stay together in its partition, in order, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.columns import batch_of, let, slices
from quarry.functions.markup import element_text, is_tagged
from quarry.functions.markup import pieces as marked_pieces
from quarry.functions.text import body_of, chunk_header, clean_line, heading_title, mostly_numbers, token_count

CHUNK_CHARS, OVERLAP, MODEL_TOKENS = 1600, 200, 512
RECITAL_TOKENS, MAX_TOKENS, SMALL_CHARS = 250, 480, 200
SEPARATORS = ("\n\n", "\n", " ", "")

# The headings by which acts are read.
ADOPTED = r"^.{0,40}HA(?:S|VE) (?:ADOPTED|DECIDED)\b.*$"
ARTICLE = r"^Article (\d+[a-z]*)[ \t]*$"
ANNEX = r"^ANNEX(?: [IVXLC]+| \d+)?\s*$"
DIVISION = r"^(CHAPTER|Chapter|TITLE|Title|SECTION|Section|PART|Part) [IVXLC\d]+[ \t]*$"
CONTAINER = "TexteOnly"
RECITAL_START = r"\n(?=\(\d+\) |Whereas )"
PARAGRAPH_START = r"\n(?=\d+\. )"


def pack(units: Column, budget: int, measure=F.length) -> Column:
    """Neighbouring units joined by newlines while their measure stays within the budget; a longer unit stands alone."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, unit: Column) -> Column:
        joined = F.concat_ws("\n", acc["now"], unit)
        full = acc["now"].isNotNull() & (measure(joined) > budget)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, unit).otherwise(joined).alias("now")
        )

    return F.aggregate(units, zero, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size`, cut at the coarsest separator that does, repeated ends of up to `overlap` between neighbours."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    held: deque[str] = deque()
    total = 0  # letters held, each part with a separator

    def flush() -> None:
        whole = sep.join(held).strip()
        if whole:
            out.append(whole)

    for part in (p for p in parts if p):
        if len(part) > size and finer:
            flush()
            held.clear()
            total = 0
            out += split_recursively(part, size, overlap, finer)
            continue
        if held and total + len(part) > size:
            flush()
            while held and (total > overlap + len(sep) or total + len(part) > size):
                total -= len(held.popleft()) + len(sep)
        held.append(part)
        total += len(part) + len(sep)
    flush()
    return out


def count_tokens(text: str) -> int:
    """token_count of one text."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def fixed_chunks(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP, most_tokens: int = MODEL_TOKENS) -> DataFrame:
    """(doc_id, chunk_index, text, tokens, start, page_start, page_end) of docs (doc_id, pages: array of texts, in order).

    Pages are joined by newlines; a chunk's pages are those of its first and last character. A chunk of more than `most_tokens` is halved until its pieces
    fit, or cannot be cut; they keep its place and pages.
    """

    @F.pandas_udf("array<struct<text:string,pieces:array<string>>>")
    def split(texts: pd.Series) -> pd.Series:
        def halved(text: str) -> list[str]:
            parts = [text] if count_tokens(text) <= most_tokens else split_recursively(text, max(len(text) // 2, 200), 0)
            return [text] if len(parts) < 2 else [piece for part in parts for piece in halved(part)]

        return texts.map(lambda t: [{"text": p, "pieces": halved(p)} for p in split_recursively(t, size, overlap)] if t else [])

    joined = docs.select("doc_id", "pages", F.array_join("pages", "\n").alias("full"))
    # Each chunk is sought behind the start of the chunk before it.
    placed = F.aggregate(
        F.col("parts"),
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")),
        lambda acc, p: let(
            F.greatest(_locate(p["text"], F.col("full"), acc["at"]), F.lit(0)),
            lambda at: F.struct(F.array_append(acc["out"], at.cast("int")).alias("out"), (at + 1).cast("int").alias("at")),
        ),
        lambda acc: acc["out"],
    )
    piece = lambda p, at: F.transform(p["pieces"], lambda t: F.struct(t.alias("text"), at.alias("start"), (at + F.length(p["text"]) - 1).alias("last")))
    starts = F.aggregate(
        F.col("pages"),
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(F.array_append(acc["out"], acc["at"]).alias("out"), (acc["at"] + F.length(p) + 1).alias("at")),
        lambda acc: acc["out"],
    )
    found = joined.withColumn("parts", split("full")).withColumn("at", placed)
    rows = found.select("doc_id", starts.alias("starts"), F.posexplode(F.flatten(F.zip_with("parts", "at", piece))).alias("chunk_index", "c"))
    page_at = lambda at: F.size(F.filter("starts", lambda s: s <= at))
    first, last = F.col("c.start"), F.col("c.last")
    return rows.select(
        "doc_id", "chunk_index", F.col("c.text").alias("text"), token_count(F.col("c.text")).alias("tokens"), first.alias("start"), page_at(first).alias("page_start"), page_at(last).alias("page_end")
    )


def _locate(part: Column, text: Column, behind: Column) -> Column:
    """The place of `part` in `text` from place `behind` on, counted from 0; -1 if it is not there."""
    return F.call_function("locate", part, text, behind + 1) - 1


def locate_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pages): the page range of each chunk body, by probes of its letters. chunks: doc_id, bodies; pages: doc_id, pages. [0, 0] is not found.

    Chunks follow the pages' order, so a probe is sought from the last hit on, and from the start only if it is not there. Other columns of chunks are kept.
    """
    from quarry.functions.text import PROBE, letters

    def places(own: list[str], bodies: list[str]) -> list[dict[str, int]]:
        full, ends, at, out = "".join(own), list(accumulate(map(len, own))), 0, []
        for body in bodies:
            n = len(body)
            probes = [body] if n <= PROBE else [body[i : i + PROBE] for i in (0, n // 4, n // 2, 3 * n // 4, n - PROBE)]
            found = ((full.find(p, at), p) for p in probes if p)
            hits = [i for i in (i if i >= 0 else full.find(p) for i, p in found) if i >= 0]
            # A page starts where the one before it ends; of pages without letters the last one counts.
            out.append({"start": _page(ends, min(hits)), "end": _page(ends, max(hits) + PROBE - 1)} if hits else {"start": 0, "end": 0})
            at = min(hits, default=at)
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def located(own: pa.Array, bodies: pa.Array) -> pa.Array:
        both = pa.RecordBatch.from_arrays([own, bodies], ["own", "bodies"])
        found = [pa.array([places(*x) for x in zip(*(c.to_pylist() for c in few.columns), strict=True)], kind) for few in slices(iter([both]))]
        return pa.concat_arrays([pa.array([], kind), *found])

    own = F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.coalesce(letters(p), F.lit("")))
    bodies = F.transform(F.coalesce("bodies", F.array().cast("array<string>")), lambda b: F.coalesce(letters(b), F.lit("")))
    kept = [c for c in chunks.columns if c not in ("doc_id", "bodies")]
    # A generator of one row keeps the search from being worked out again in filters above it.
    return chunks.join(pages, "doc_id", "left").select("doc_id", *kept, F.explode(F.array(located(own, bodies))).alias("pages"))


def _page(ends: list[int], at: int) -> int:
    """The number, from 1 on, of the last page that starts at or before place `at`, if each page ends at its place in `ends`."""
    return min(bisect_right(ends, at) + 1, len(ends))


# Structure ---------------------------------------------------------------------------------------------------------------


def article_lines(lines: Column, after: Column) -> Column:
    """Line numbers of the act's own article headings behind line `after`.

    A number far ahead (by over 20) is a reference and is skipped; the run ends where numbering starts again at 1 or falls back by over 3.
    """
    marked = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, r"^Article (\d+)[a-z]*[ \t]*$", 1).try_cast("int").alias("n"))),
        lambda x: x["n"].isNotNull() & (x["i"] > after),
    )
    zero = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("top"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        begun = F.size(acc["kept"]) > 0
        over = acc["over"] | (begun & ((x["n"] == 1) | (x["n"] < acc["top"] - 3)) & (x["n"] <= acc["top"] + 20))
        take = ~over & ~(begun & (x["n"] > acc["top"] + 20))
        return F.struct(
            F.when(take, F.array_append(acc["kept"], x["i"])).otherwise(acc["kept"]).alias("kept"),
            F.when(take, F.greatest(acc["top"], x["n"])).otherwise(acc["top"]).alias("top"),
            over.alias("over"),
        )

    return F.aggregate(marked, zero, step, lambda acc: acc["kept"])


def pieces(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, place, section, label, body) of docs (doc_id, text): preamble, articles and annexes; one body where there is no article.

    With columns to keep. A piece gets its own lines before the document is split, and the pieces of a document follow one another.
    """
    at = lambda pattern: F.filter(F.transform(F.col("lines"), lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    once = lambda value, name: F.explode(F.array(value)).alias(name)  # noqa: E731  a generator of one row keeps a value from being worked out again at each use
    one = docs.select("doc_id", *keep, once(F.split(F.coalesce("text", F.lit("")), "\n", -1), "lines"))
    one = one.select("doc_id", *keep, "lines", once(F.struct(at(ADOPTED).alias("adopted"), at(ANNEX).alias("annexes"), at(DIVISION).alias("divisions")), "h"))
    adopted = F.get("h.adopted", F.lit(0))
    one = one.select("*", once(article_lines(F.col("lines"), F.coalesce(adopted, F.lit(-1))), "articles"))
    first, last = F.get("articles", F.lit(0)), F.try_element_at("articles", F.lit(-1))
    count = F.size("lines")
    one = one.select("doc_id", *keep, "lines", "articles", once(F.filter("h.annexes", lambda i: i > last), "annexes"), F.col("h.divisions").alias("divisions"), F.coalesce(adopted, first).alias("preamble_end"))
    annex_start = F.coalesce(F.get("annexes", F.lit(0)), count)
    part = lambda section, a, z: F.struct(F.lit(section).alias("section"), a.alias("a"), z.alias("z"))
    plan = F.when(F.size("articles") == 0, F.array(part("body", F.lit(-1), count))).otherwise(
        F.concat(
            F.array(part("preamble", F.lit(-1), F.col("preamble_end"))),
            F.transform("articles", lambda a, i: part("article", a, F.coalesce(F.get("articles", i + 1), annex_start))),
            F.transform("annexes", lambda a, i: part("annex", a, F.coalesce(F.get("annexes", i + 1), count))),
        )
    )
    line = lambda i: F.get("lines", i)
    division_text = lambda i: F.trim(
        F.concat_ws(" ", F.trim(line(i)), F.when((F.length(F.coalesce(line(i + 1), F.lit(""))) <= 120) & ~line(i + 1).rlike(ARTICLE), F.trim(line(i + 1))))
    )
    named = F.transform("divisions", lambda i: F.struct(i.alias("i"), F.lower(line(i)).startswith("section").alias("sub"), division_text(i).alias("text"), (F.length(line(i + 1)) <= 120).alias("short")))
    one = one.select("doc_id", *keep, "lines", "divisions", annex_start.alias("annex_start"), once(plan, "plan"), once(named, "named"))

    def own(p: Column) -> Column:
        """A piece with its lines and the divisions above it. Division headings at an article's end, and their title lines, belong to what follows."""
        is_title = lambda i, x: F.array_contains("divisions", i - 1) & (F.length(x) <= 120) & ~F.array_contains("divisions", i)
        heads = lambda i, x: (p["section"] == "article") & (F.array_contains("divisions", i) | is_title(i, x))
        inside = F.slice("lines", p["a"] + 2, F.greatest(p["z"] - p["a"] - 1, F.lit(0)))
        kept = F.when(F.size("divisions") == 0, inside).otherwise(F.filter(inside, lambda x, k: ~heads(p["a"] + 1 + k, x)))
        earlier = F.filter("named", lambda d: (d["i"] < p["a"]) & (d["i"] < F.col("annex_start")))
        top = F.try_element_at(F.filter(earlier, lambda d: ~d["sub"]), F.lit(-1))
        sub = let(top, lambda t: F.try_element_at(F.filter(earlier, lambda d: d["sub"] & (d["i"] > F.coalesce(t["i"], F.lit(-1)))), F.lit(-1))["text"])
        text = F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")
        return F.struct(p["section"].alias("section"), text.alias("text"), F.when(p["a"] >= 0, F.trim(line(p["a"]))).otherwise("").alias("named"), top["text"].alias("top"), sub.alias("sub"))

    rows = one.select("doc_id", *keep, F.posexplode(F.transform("plan", own)).alias("place", "p"))
    titled = F.when(F.col("p.section").isin("article", "annex"), heading_title(F.col("p.text"))).otherwise(F.struct(F.lit("").alias("title"), F.col("p.text").alias("rest")))
    out = rows.select("doc_id", *keep, "place", "p.section", "p.named", "p.top", "p.sub", once(titled, "t"))
    heading = F.concat_ws(" ", F.when(F.col("section") == "annex", F.initcap("named")).otherwise(F.col("named")), F.nullif(F.col("t.title"), F.lit("")))
    label = F.when(F.col("section") == "article", F.concat_ws(" | ", "top", "sub", heading)).otherwise(heading)
    return out.select("doc_id", "place", "section", label.alias("label"), F.regexp_replace("t.rest", r"^\s+|\s+$", "").alias("body"), *keep).where("body <> ''")


def structure_chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS, html: bool = False, marked: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_index, section, label, text) of docs (doc_id, title, text): pieces split at their units and packed to a token budget.

    `marked` holds pieces known from markup, with their title; texts are read for those of the other documents, and those with a null text have none.

    Recitals take RECITAL_TOKENS where the text came from HTML. Annex parts with more digits than letters go then too, recitals are merged and named by their range, and
    short parts join the one before them. A unit over the budget is cut by size. Rows of one doc_id are documents of their own.
    """
    keep = ("title", "__row")
    found = pieces(docs.where("text is not null").withColumn("__row", F.monotonically_increasing_id()), keep)
    found = (found.unionByName(marked) if marked is not None else found).withColumn("label", F.when(F.col("section") == "preamble", F.lit("Recitals" if html else "Preamble and recitals")).otherwise(F.col("label")))
    named = found.withColumn("header", chunk_header(F.col("title"), F.col("label")))
    units = (
        F.when(F.col("section") == "preamble", F.split("body", RECITAL_START))
        .when(F.col("section") == "article", F.split("body", PARAGRAPH_START))
        .otherwise(F.split("body", "\n") if html else F.array("body"))
    )
    budget = F.when((F.col("section") == "preamble") & F.lit(html), F.lit(RECITAL_TOKENS)).otherwise(F.lit(max_tokens)) - token_count(F.col("header"))

    def fit(text: str, limit: int) -> list[str]:
        """The split of the largest size tried, from half the text down by quarters to 400 letters, of which all parts fit; else the finest."""
        if count_tokens(text) <= limit:
            return [text]
        sizes = [max(len(text) // 2, 400)]
        while sizes[-1] > 400:
            sizes.append(sizes[-1] * 3 // 4)
        splits = (split_recursively(text, size, 0) for size in sizes)
        return next((parts for parts in splits if all(count_tokens(p) <= limit for p in parts)), None) or split_recursively(text, sizes[-1], 0)

    def packed(units: list[str], room: int) -> list[str]:
        """Neighbouring units, trimmed, joined by newlines while their tokens fit."""
        out: list[str] = []
        now, n = [], 0
        for unit in (u.strip(" ") for u in units):
            if not unit:
                continue
            more = count_tokens(unit)
            if now and n + more > room:
                out.append("\n".join(now))
                now, n = [], 0
            now.append(unit)
            n += more
        return [*out, "\n".join(now)] if now else out

    key = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {key}, chunk_index int, section string, label string, text string"
    schema, part_columns = to_arrow_schema(T.StructType.fromDDL(columns)), f"__row long, doc_id {key}, section string, label string, header string, body string"
    part_schema = to_arrow_schema(T.StructType.fromDDL(part_columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in slices(batches):
            *own, groups, room = (c.to_pylist() for c in few.columns)
            rows = [(*x, p) for *x, units, n in zip(*own, groups, room, strict=True) for group in packed(units, n) for p in fit(group, n)]
            yield batch_of(rows, part_schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = None, []
        for few in slices(batches):
            done = []
            for own, *values in zip(*(c.to_pylist() for c in few.columns), strict=True):
                if own != row:
                    done += finished(held, html, max_tokens)
                    row, held = own, []
                held.append(Part(*values))
            yield batch_of(done, schema)
        yield batch_of(finished(held, html, max_tokens), schema)

    placed = named.select("__row", "doc_id", "section", "label", "header", units.alias("units"), budget.alias("room"))
    if not html:
        return placed.mapInArrow(lambda batches: number(cut(batches)), columns)
    parts = placed.mapInArrow(cut, part_columns).where(~((F.col("section") == "annex") & mostly_numbers(F.col("body"))))
    return parts.mapInArrow(number, columns)


@dataclass
class Part:
    """A part of a piece."""

    doc_id: object
    section: str
    label: str
    header: str
    body: str


def finished(parts: list[Part], html: bool, max_tokens: int) -> list[tuple]:
    """(doc_id, chunk_index, section, label, text) of the parts of one document."""
    if html:
        parts = merge_small(merge_recitals(parts), max_tokens)
    return [(p.doc_id, i, p.section, p.label, f"{p.header}\n{p.body}") for i, p in enumerate(parts)]


def _joined(parts: list[Part], joins: Callable[[Part, int, Part, int], int | None], join: Callable[[Part, Part], str]) -> list[Part]:
    """Each part joined to the one before it where `joins` says how many tokens both then have; token counts are carried along."""
    out: list[Part] = []
    tokens = 0
    for part in parts:
        own = count_tokens(part.body)
        if out and (total := joins(out[-1], tokens, part, own)) is not None:
            out[-1] = replace(out[-1], body=join(out[-1], part))
            tokens = total
        else:
            out.append(part)
            tokens = own
    return out


def merge_recitals(parts: list[Part]) -> list[Part]:
    """Neighbouring recitals that fit RECITAL_TOKENS under one header, named by the range of their numbers."""

    def joins(a: Part, a_tokens: int, b: Part, b_tokens: int) -> int | None:
        fits = a.section == b.section == "preamble" and count_tokens(a.header) + a_tokens + b_tokens <= RECITAL_TOKENS
        return a_tokens + b_tokens if fits else None

    def named(p: Part) -> Part:
        numbers = re.findall(r"(?m)^\(([0-9]+)\)", p.body) if p.section == "preamble" else []
        if not numbers:
            return p
        label = f"Recitals ({numbers[0]})" + (f"-({numbers[-1]})" if len(numbers) > 1 else "")
        return replace(p, label=label, header=(p.header.rpartition(" | ")[0] if " | " in p.header else p.header) + f" | {label}")

    return [named(p) for p in _joined(parts, joins, lambda a, b: f"{a.body}\n{b.body}")]


def merge_small(parts: list[Part], max_tokens: int) -> list[Part]:
    """Parts of less than SMALL_CHARS letters join the one before them in their section, under the last part of their label, if both fit."""
    short = lambda p: p.label.rpartition(" | ")[2]

    def joins(a: Part, a_tokens: int, b: Part, b_tokens: int) -> int | None:
        small = a.section == b.section and len(b.body) < SMALL_CHARS
        if not small or count_tokens(a.header) + a_tokens + count_tokens(b.label) + 1 + b_tokens > max_tokens:
            return None
        return a_tokens + count_tokens(short(b)) + 1 + b_tokens

    return _joined(parts, joins, lambda a, b: f"{a.body}\n{short(b)}: {b.body}")


def paged_chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """structure_chunks of docs (doc_id, title, pages: array of texts), with the pages of each chunk's body: page_start, page_end, 0 where not found."""
    whole = docs.select("doc_id", "title", F.array_join("pages", "\n").alias("text"))
    own = ("chunk_index", "section", "label", "text")
    chunks = structure_chunks(whole, max_tokens).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("c"))
    placed = locate_pages(chunks.withColumn("bodies", F.transform("c", lambda x: body_of(x["text"]))), docs.select("doc_id", "pages"))
    rows = placed.select("doc_id", F.explode(F.arrays_zip("c", "pages")).alias("x"))
    return rows.select("doc_id", *(f"x.c.{name}" for name in own), F.col("x.pages.start").alias("page_start"), F.col("x.pages.end").alias("page_end"))


# HTML --------------------------------------------------------------------------------------------------------------------


def html_text(html: Column) -> Column:
    """The text of a page, a line for each paragraph; a table row of up to three cells is one line. Scripts, styles and comments go."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|^\s*<\?xml[^>]*\?>", ""), r"(?i)<br\s*/?>", "\n")
    cells = F.regexp_replace(F.regexp_replace(plain, r"(?i)(<td\b[^>]*>)\s*<p\b[^>]*>", "$1"), r"(?i)</p>\s*(?=</td>)", "")
    rows = F.regexp_replace(cells, r"(?i)</td>\s*<td\b[^>]*>", " ")
    marked = F.regexp_replace(rows, r"(?i)<p\b[^>]*>|</p\s*>|<tr\b[^>]*>|</tr\s*>|</?(?:div|table|article|nav|ul|li|h\d|title|body|head)\b[^>]*>", "\u0001")
    bare = F.regexp_replace(marked, r"(?s)<[^>]*>", "")
    known = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
    for entity, char in known.items():
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(bare, "\u0001"), clean_line)
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")


def html_chunks(pages: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """structure_chunks of HTML pages (doc_id, title, html), by element ids where a page is marked up and by its headings elsewhere."""
    # Of a plain page only the act itself is read, where an element holds it; menus and footers stand outside.
    plain = ~is_tagged(F.col("html"))
    held = F.when(plain & F.col("html").contains(CONTAINER), F.col("html"))
    text = F.when(plain, F.coalesce(element_text(held, CONTAINER), html_text(F.col("html"))))
    marked = marked_pieces(pages.withColumn("__row", F.monotonically_increasing_id()), ("title", "__row"))
    # A generator of one row keeps the text from being worked out again for each filter on it.
    return structure_chunks(pages.select("doc_id", "title", F.explode(F.array(text)).alias("text")), max_tokens, html=True, marked=marked)
