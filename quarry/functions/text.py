"""Text functions as Column expressions: cleaning, guards, labels, citations. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.columns import let

# The patterns and word lists that results depend on. ------------------------------------------------------

INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"forget\s+(all\s+)?previous",
    r"new\s+instructions\s*:",
    r"system\s*prompt",
    r"---\s*end\s*(of)?\s*prompt",
    r"pretend\s+you\s+are",
    r"act\s+as\s+(if\s+)?you",
    r"bypass\s+(all\s+)?restrictions",
    r"reveal\s+(your|the)\s+(system|instructions|prompt)",
    r"you\s+are\s+now\s+(DAN|jailbroken)",
)
HARMFUL = (r"here('?s| is) (how|the way) to (hack|steal|attack)", r"password\s+is\s+", r"api[_\s]?key\s*[:=]")
PII = {
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "phone": r"\+?\d[\d\s\-()]{7,}\d",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
}
COMMON_WORDS = (
    "the of and to in a is for be shall by on that this with as or are from which member states "
    "article regulation directive decision council commission european union community"
).split()
PAGE_FURNITURE = (
    r"Official Journal of the European (Union|Communities).*",
    r"[LC]\s?\d+\s?/\s?\d+",
    r"\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4}",
    r"\d{1,4}",
    r"EN",
)
SCAN_FURNITURE = (
    r"Official Journal of the European (Union|Communities).*",
    r"OJ [LC],? ?\d{1,2}\.\d{1,2}\.\d{4}",
    r"ELI: ?http\S*",
    r"\d{1,4} ?/ ?\d{1,4}",
    r"(No )?[LC] ?\d+ ?/ ?\d+",
    r"\d{1,2} ?\. ?\d{1,2} ?\. ?\d{2,4}",
    r"EN",
    r"\\",
)
CONTINUATION_WORDS = "the of this and to in a an for by with or that on as".split()
COLLECTIONS = {"REG": "Regulation", "DIR": "Directive", "DEC": "Decision", "RECO": "Recommendation"}
MIN_CHARS_PER_PAGE, MIN_COMMON_SHARE = 80, 0.06
PROBE = 50
TITLE_CHARS = 250
PRICE_IN, PRICE_OUT = 0.3, 2.5

# The line ends that are known beside the plain one, and white space other than the plain line end.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANKS = "\t\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Cleaning --------------------------------------------------------------------------------------------------------------


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def _furniture(patterns: tuple[str, ...]) -> str:
    return r"(?md)^\s*(" + "|".join(patterns) + r")\s*$"


#: Steps that both cleaners take: NULs and split words go; lines of any ending are trimmed; surplus empty lines go.
_UNBROKEN = ((r"\x00", ""), ("\xad\\s*", ""), (r"([a-z])-\n([a-z])", "$1$2"))
_TRIMMED = ((LINE_ENDS, "\n"), (f"(?md)^[{BLANKS}]+|[{BLANKS}]+$", ""))
_CLOSED = ((r"\n{3,}", "\n\n"), (f"^[\n{BLANKS}]+|[\n{BLANKS}]+$", ""))


def clean_page(text: Column) -> Column:
    """Text of a page without NULs, split words, journal headers, page numbers and surplus white space. Null stays null."""
    return _chain(text, *_UNBROKEN, (_furniture(PAGE_FURNITURE), ""), ("[ \t\xa0]+", " "), *_TRIMMED, *_CLOSED)


def join_spaced_words(text: Column) -> Column:
    """'S e c t i o n' becomes 'Section': runs of four or more single letters lose their spaces."""
    inside = r"(?<=\b[A-Za-z]) (?=[A-Za-z]\b)"
    run = r"\b(?:[A-Za-z] ){3,}[A-Za-z]\b"
    gaps, hits = F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), F.lit(0))
    joined = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.regexp_replace(h, inside, ""), F.lit(""))))
    return F.when(text.rlike(run), F.array_join(joined, "")).otherwise(text)


def clean_scan(text: Column) -> Column:
    """As clean_page for scanned pages: also joins spaced words and lone numbers, and drops dot leaders; headers go after trimming."""
    return _chain(
        join_spaced_words(_chain(text, *_UNBROKEN)),
        (r"( ?\. ?){5,}", " "),
        ("[ \t\xa0]+", " "),
        *_TRIMMED,
        (_furniture(SCAN_FURNITURE), ""),
        (r"(?md)^(\d+ ?\.|\([a-z0-9]+\))\n(?=\S)", "$1 "),
        *_CLOSED,
    )


def letters(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def clean_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t ]+", " "))


# Measures and labels ---------------------------------------------------------------------------------------------------


def text_status(text: Column, pages: Column) -> Column:
    """ok, no_text (too short for its pages) or garbled (too few common words)."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    common = F.size(F.filter(words, lambda w: F.lower(w).isin(*COMMON_WORDS)))
    return (
        F.when(text.isNull() | (F.length(text) < MIN_CHARS_PER_PAGE * F.greatest(pages, F.lit(1))), "no_text")
        .when((F.size(words) == 0) | (common < MIN_COMMON_SHARE * F.size(words)), "garbled")
        .otherwise("ok")
    )


def mostly_numbers(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}+", "")) > F.length(F.regexp_replace(text, r"\P{L}+", ""))


def collection_of(resource_type: Column) -> Column:
    """REG_IMPL is a Regulation; unknown or null is Other."""
    kind = F.substring_index(resource_type, "_", 1)
    named = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(COLLECTIONS.items())[1:], F.when(kind == "REG", COLLECTIONS["REG"]))
    return named.otherwise("Other")


def body_of(chunk: Column) -> Column:
    """What follows the header line; the whole text if there is one line."""
    at = F.instr(chunk, "\n")
    return F.when(at > 0, F.substring(chunk, at + 1, F.lit(2**31 - 1))).otherwise(chunk)


def is_recital(chunk: Column) -> Column:
    return F.substring_index(F.substring_index(chunk, "\n", 1), " | ", -1).startswith("Recitals")


def probes(text: Column) -> Column:
    """Up to five slices of PROBE letters: start, quarters, end. A short text is its own probe; an empty one has none."""
    n = F.length(text)
    starts = F.array(F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), n - PROBE)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= PROBE, F.array(text))
        .otherwise(F.transform(starts, lambda s: F.substring(text, (s + 1).cast("int"), F.lit(PROBE))))
    )


def spans_of(text: Column, width: int) -> Column:
    """Every run of `width` letters; a shorter text has none."""
    many = F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substring(text, i, F.lit(width)))
    return F.when(F.length(text) >= width, many).otherwise(F.array().cast("array<string>"))


def short_title(title: Column) -> Column:
    """At most TITLE_CHARS, cut at the last space and marked with dots."""
    title = F.trim(F.coalesce(title, F.lit("")))
    head = F.substring(title, 1, TITLE_CHARS)
    return F.when(F.length(title) > TITLE_CHARS, F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("..."))).otherwise(title)


def chunk_header(title: Column, label: Column) -> Column:
    return F.concat_ws(" | ", short_title(title), F.when(label != "", label))


def heading_title(body: Column) -> Column:
    """struct(title, rest): a short first line that reads like a title, or an empty title and the whole body."""
    first, rest = F.trim(F.substring_index(body, "\n", 1)), F.regexp_replace(body_of(body), r"^\s+|\s+$", "")
    last_word = F.lower(F.regexp_extract(first, r"(\S+)$", 1))
    is_title = (
        body.contains("\n") & (first != "") & (rest != "") & (F.length(first) <= 120)
        & ~first.rlike(r"^[\p{Nd}(]") & ~first.rlike("[.;:,]$") & ~last_word.isin(*CONTINUATION_WORDS) & rest.rlike(r"^[\p{Lu}\p{Nd}(]")
    )
    return F.struct(F.when(is_title, first).otherwise("").alias("title"), F.when(is_title, rest).otherwise(body).alias("rest"))


def token_count(text: Column) -> Column:
    """Words and single punctuation marks: the default where no model's tokenizer is given."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


# Guards ----------------------------------------------------------------------------------------------------------------


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def looks_injected(text: Column) -> Column:
    return any_of(text, INJECTION)


def looks_harmful(text: Column) -> Column:
    return any_of(text, HARMFUL)


def mask_pii(text: Column) -> Column:
    """Kinds in order, so a phone pattern takes cards and numbers that it covers."""
    return _chain(text, *((p, f"[{kind.upper()}]") for kind, p in PII.items()))


def count_pii(text: Column) -> dict[str, Column]:
    return {kind: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long") for kind, p in PII.items()}


def sanitise(text: Column) -> Column:
    return F.trim(F.replace(F.replace(_chain(text, ("-{3,}", ""), ("={3,}", "")), F.lit("{{"), F.lit("{ {")), F.lit("}}"), F.lit("} }")))


def checked_output(text: Column) -> Column:
    """Masked text, or a notice in place of harmful text."""
    return F.when(looks_harmful(text), F.lit("Response removed due to harmful content.")).otherwise(mask_pii(text))


# Answers and conversations -----------------------------------------------------------------------------------------------


def cited_numbers(answer: Column) -> Column:
    """Numbers in [1] or [2, 3], in order of first mention. Numbers too long for an int are left out."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: x.try_cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull()))


def link_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\[(\d+)\](?!\()", "[$1](#cite-$1)")


def conversation_title(query: Column) -> Column:
    clean = F.trim(F.regexp_replace(query, r"\s+", " "))
    return F.when(F.length(clean) > 48, F.concat(F.rtrim(F.substring(clean, 1, 45)), F.lit("…"))).otherwise(clean)


def date_bucket(ts: Column, now: Column) -> Column:
    days = F.datediff(F.to_date(now), F.to_date(ts))
    return (
        F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Previous 7 days").when(days <= 30, "Previous 30 days").otherwise("Older")
    )


def format_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.format_string("%.2f", ms / 1000), F.lit(" s"))).otherwise(F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms")))


def format_percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", share * 100), F.lit("%"))


def format_usd(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.when(amount < 0.01, F.format_string("%.5f", amount)).otherwise(F.format_string("%.2f", amount)))


def format_number(n: Column) -> Column:
    """With grouped digits; from 100,000 on in thousands (K), millions (M), billions (B) or trillions (T), with a decimal below 10 of them."""
    grouped = F.regexp_replace(F.regexp_replace(F.format_number(n.cast("double"), 3), r"0+$", ""), r"\.$", "")

    def compact(unit: float, sign: str) -> Column:
        few = F.bround(n / unit, 1)
        shown = F.when(few < 10, F.regexp_replace(F.format_string("%.1f", few), r"\.0$", "")).otherwise(F.bround(n / unit, 0).cast("long").cast("string"))
        return F.concat(shown, F.lit(sign))

    units = F.when(n >= 999.5e9, compact(1e12, "T")).when(n >= 999.5e6, compact(1e9, "B")).when(n >= 999.5e3, compact(1e6, "M"))
    return F.when(n < 100_000, grouped).otherwise(units.otherwise(compact(1e3, "K")))


def title_holds(title: Column, wanted: str) -> Column:
    """Whether a conversation's title holds these letters, in any case; an empty wish takes all."""
    return F.contains(F.lower(title), F.lit(wanted.strip().lower()))


def valid_question(question: Column) -> Column:
    """Questions have 1 to 1000 characters."""
    return F.coalesce(F.length(question).between(1, 1000), F.lit(False))


def prompt(instructions: str, sources: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{instructions}\n\nSources:\n\n"), sources, F.lit("\n\nQuestion: "), question)


def usable_citations(citations: Column) -> Column:
    """Those with a document and a page."""
    return F.filter(citations, lambda c: c["doc_id"].isNotNull() & c["page"].isNotNull())


def text_blocks(blocks: Column) -> Column:
    """The text of blocks of type text, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def source_passage(n: Column, title: Column, doc_id: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    """A numbered passage under its title (the document's id where that is empty) and pages (none where they are not known)."""
    pages = F.when(page_start == page_end, F.concat(F.lit(" (page "), page_start, F.lit(")"))).otherwise(F.concat(F.lit(" (pages "), page_start, F.lit("-"), page_end, F.lit(")")))
    named = F.coalesce(F.nullif(title, F.lit("")), doc_id.cast("string"), F.lit(""))
    return F.concat(F.lit("["), n, F.lit("] "), named, F.coalesce(pages, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def cache_scope(*parts: Column) -> Column:
    return F.substring(cache_key(*parts), 1, 16)


def answer_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / F.lit(1e6) * PRICE_IN + tokens_out / F.lit(1e6) * PRICE_OUT


# Passages ----------------------------------------------------------------------------------------------------------------

NEEDLE_CHARS = 400


def normalised_words(text: Column) -> Column:
    """Text with single spaces, as it is searched."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def passage_range(page: Column, quote: Column) -> Column:
    """struct(from, to) of the quote on the page, both normalised, counted from 0; null where it is not found.

    The longest opening phrase that the page has decides the start: eight, five or three words, begun up to three words in. The end is that of the quote's
    last four words behind it, else the quote's length. Without such a phrase the window of the quote's length with most of its longer words counts, if it has half of them.
    """

    def located(p: Column, q: Column, words: Column) -> Column:
        def phrase(skip: int, size: int) -> Column:
            found = F.instr(p, F.array_join(F.slice(words, skip + 1, size), " ")) - 1
            return F.when((F.size(words) >= skip + size) & (found >= 0), found)

        start = F.coalesce(*(phrase(skip, size) for skip in range(4) for size in (8, 5, 3)))
        tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 3), 4), " ")

        def ranged(at: Column) -> Column:
            behind = F.call_function("locate", tail, p, at + 1) - 1
            end = F.when(behind >= 0, behind + F.length(tail)).otherwise(at + F.length(q))
            return F.struct(at.alias("from"), end.alias("to"))

        return F.when(start.isNotNull(), let(start, ranged)).otherwise(_best_overlap(p, words))

    return let(normalised_words(page), lambda p: let(F.substring(normalised_words(quote), 1, NEEDLE_CHARS), lambda q: let(F.filter(F.split(q, " "), lambda w: w != ""), lambda w: located(p, q, w))))


def _best_overlap(page: Column, needle: Column) -> Column:
    wanted = F.array_distinct(F.filter(needle, lambda w: F.length(w) > 3))

    def scored(words: Column, good: Column, width: Column) -> Column:
        hits = F.transform(words, lambda w: F.array_contains(good, w).cast("int"))
        starts = F.sequence(F.lit(0), F.size(words) - width)
        scores = let(hits, lambda h: F.transform(starts, lambda s: F.aggregate(F.slice(h, s + 1, width), F.lit(0), lambda a, x: a + x)))
        best = let(scores, lambda c: F.struct(F.array_max(c).alias("score"), (F.array_position(c, F.array_max(c)) - 1).cast("int").alias("s")))

        def ranged(b: Column) -> Column:
            before = F.aggregate(F.transform(F.slice(words, 1, b["s"]), lambda w: F.length(w) + 1), F.lit(0), lambda a, x: a + x)
            inside = F.length(F.array_join(F.slice(words, b["s"] + 1, width), " "))
            return F.when(2 * b["score"] >= F.size(good), F.struct(before.alias("from"), (before + inside).alias("to")))

        return let(best, ranged)

    enough = lambda words, good: (F.size(good) >= 4) & (F.size(words) > 0)
    return let(
        F.filter(F.split(page, " "), lambda w: w != ""),
        lambda words: let(wanted, lambda good: F.when(enough(words, good), scored(words, good, F.least(F.size(needle), F.size(words))))),
    )
