"""Answer clean-up, compression, extraction and prompts as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a refusal, the marks stripped around an answer, and its leading phrases.
REFUSAL = "unanswerable"
REFUSALS = ("unanswerable", "not answerable", "not supported")
QUOTES = "[\"'`]+"
LEADS = (r"(?U)^\s*\[\d+\]\s*", r"(?iU)^\s*(answer|final answer)\s*:\s*", r"(?iU)^\s*the answer is\s+")
TRAILING_CITE, TRAILING_NOTE, TRAILING_MARKS = r"(?U)\s+\[\d+\]\s*$", r"(?iU)\s*\([^)]*implies[^)]*\)\s*$", r"[ .;:]+$"
# Number words and the patterns of the compression rules, in the order in which they apply.
NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
NUMBER = rf"(?:\d[\d,]*(?:\.\d+)?|{NUMBERS})"
ABOUT = r"(?:over\s+|about\s+|approximately\s+|around\s+|at least\s+)?"
QUANTITY = rf"\b{ABOUT}{NUMBER}(?:\s+or\s+{NUMBER})?(?:\s+(?:million|billion|thousand|hundred))?"
BARE_QUANTITY = rf"{ABOUT}{NUMBER}(?:\s+or\s+{NUMBER})?(?:\s+(?:million|billion|thousand|hundred|acts?))?"
SOURCE_NOTE = r"\s*\((?:from|see|passage|source)[^)]*\)\s*$"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"\b(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b|\b\d{{4}}\b"
SUBJECT = r"^(.+?)\s+(?:is|was|are|were|has|have|had|did|does|do|disliked|founded|owned|performed|played|caused|expanded|includes|include|contains|contain|premiered|defended|lies|lie|located)\b"
ORIGIN = r"\bfrom\s+([^,.;]+?)(?:\s+to\b|$)"
PLACES = (r"\bin\s+(the\s+[^,.;]+|[^,.;]+)", r"\bat\s+(the\s+[^,.;]+|[^,.;]+)")
OWNER, FOUNDER, CAUSED = r"\bowned by\s+(.+)$", r"\bfounded by\s+(.+)$", r"\bcaused\s+([^,.;]+)"
DEFINITIONS = (
    r"\b(?:is|are|was|were)\s+(?:now\s+)?(?:an?\s+|the\s+)?([^.;]+)",
    r"\bhave\s+(?:an?\s+|the\s+)?([^.;]+)",
    r"\bmeans\s+([^.;]+)",
    r"\brefers to\s+([^.;]+)",
    r"\brestrain(?:s|ed)?\s+(?:an?\s+|the\s+)?([^.;]+)",
)
REFINE_PHRASES = (" is ", " are ", " was ", " were ", " owned by ", " founded by ", " performed by ", " played by ", " from ", " to ", " implies ")
REFINE_MARKS = r"[\[\]():]"


def strip(c: Column, chars: str = r"(?U)\s") -> Column:
    flags, chars = ("(?U)", r"\s") if chars == r"(?U)\s" else ("", chars)
    return F.regexp_replace(F.regexp_replace(c, f"{flags}^{chars}+", ""), f"{flags}{chars}+$", "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]")


def _full_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines(c), lambda x: strip(x)), lambda x: x != ""), "\n")


def _without_leads(c: Column) -> Column:
    for lead in LEADS:
        c = F.regexp_replace(c, lead, "")
    return strip(F.regexp_replace(F.regexp_replace(strip(c), f"^{QUOTES}", ""), f"{QUOTES}$", ""))


def normalize_response(c: Column, multiline: bool = False) -> Column:
    """The first line, or all lines joined, without leading cites and phrases, quotes, trailing cites and marks; refusals become one word."""
    text = strip(c)
    first = strip(F.get(lines(text), F.lit(0)))
    out = _without_leads(_full_lines(text) if multiline else first)
    out = F.regexp_replace(F.regexp_replace(out, TRAILING_CITE, ""), TRAILING_NOTE, "")
    if not multiline:
        out = F.regexp_replace(out, TRAILING_MARKS, "")
        refused = F.lower(out).rlike("|".join(REFUSALS))
    else:
        refused = F.lower(out).isin(*REFUSALS)
    return F.when(text == "", text).when(refused, REFUSAL).otherwise(out)


def normalize_complete(c: Column) -> Column:
    """The multi-line variant without the rules for trailing cites."""
    out = _without_leads(_full_lines(strip(c)))
    return F.when(F.lower(out).isin(*REFUSALS), REFUSAL).otherwise(out)


def _find(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null where there is none; letter case doesn't count."""
    return F.when(c.rlike(f"(?iU){pattern}"), F.regexp_extract(c, f"(?iU){pattern}", group))


def compress_answer(question: Column, answer: Column) -> Column:
    """The shortest span by the first rule that applies: quantities, dates, subjects, places, owners, founders, causes, definitions."""
    text = strip(answer)
    cleaned = F.regexp_replace(strip(F.regexp_replace(text, f"(?iU){SOURCE_NOTE}", "")), r"[ .;:,]+$", "")
    return let(F.struct(text.alias("t"), cleaned.alias("c"), strip(F.lower(question)).alias("q")), lambda x: _compressed(x["t"], x["c"], x["q"]))


def _compressed(text: Column, cleaned: Column, q: Column) -> Column:
    trimmed = lambda x: strip(strip(x), ",+")
    amount = strip(_find(cleaned, QUANTITY))
    amount = F.when(cleaned.rlike(r"(?iU)\bacts?\b"), F.concat(amount, F.lit(" acts"))).otherwise(amount)
    date = F.when(cleaned.rlike(f"(?U){DATE}"), F.regexp_extract(cleaned, f"(?U){DATE}", 0))
    where = F.coalesce(F.when(q.rlike("start|begin"), strip(_find(cleaned, ORIGIN, 1))), *[strip(_find(cleaned, p, 1)) for p in PLACES])
    rules = [
        F.when(F.startswith(q, F.lit("how many")) | F.contains(q, F.lit("population")), amount),
        F.when(F.startswith(q, F.lit("when")) | F.contains(q, F.lit("what year")), date),
        F.when(F.startswith(q, F.lit("who")), trimmed(_find(cleaned, SUBJECT, 1))),
        F.when(F.startswith(q, F.lit("where")), where),
        trimmed(_find(cleaned, OWNER, 1)),
        trimmed(_find(cleaned, FOUNDER, 1)),
        strip(_find(cleaned, CAUSED, 1)),
        F.when(q.rlike("^(what|which)"), F.coalesce(*[strip(_find(cleaned, p, 1)) for p in DEFINITIONS])),
        cleaned,
    ]
    return F.when((text == "") | (text == REFUSAL), text).otherwise(F.coalesce(*rules))


def should_refine(c: Column) -> Column:
    """P10: long answers, and shorter ones with marks or verbs of a sentence; bare quantities never."""
    n = F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))
    marked = c.rlike(REFINE_MARKS)
    phrase = F.lower(c).rlike("|".join(REFINE_PHRASES))
    return F.when((c == "") | (c == REFUSAL) | ((n <= 4) & ~marked) | c.rlike(rf"(?iU)\A{BARE_QUANTITY}\z"), False).otherwise((n >= 7) | marked | phrase)


# What an extractive answer passes over and its limits.
SKIPPED_LINE = r"(?iU)^(matched queries:|title:|\[\d+\]\s+title:)"
NO_CONTEXT = "I do not have grounded context yet."


def extractive_answer(question: Column, context: Column, most: int = 3, characters: int = 360) -> Column:
    """The sentences that share most terms with the question, at most `most`, in their order in the context.

    Score: shared distinct terms, and 0.2 where a question term stands anywhere in the sentence; sentences of fewer than 4
    terms count only where no other is left; ties go to the earlier one.
    """
    kept = F.filter(F.transform(lines(context), lambda x: strip(x)), lambda x: (x != "") & ~x.rlike(SKIPPED_LINE))
    kept = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^#+\s*", ""), r"(?U)^[-*]\s*", ""))
    clean = F.when(F.size(kept) > 0, F.array_join(kept, ". ")).otherwise(context)
    parts = F.filter(F.transform(F.split(clean, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: strip(s)), lambda s: s != "")
    terms = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\w+"), F.lit(0))), lambda t: F.length(t) > 2)
    answer = let(F.struct(clean.alias("clean"), parts.alias("parts"), terms.alias("terms")), lambda x: _extracted(x["clean"], x["parts"], x["terms"], most, characters))
    return F.when(context.isNull() | (context == ""), NO_CONTEXT).otherwise(answer)


def _extracted(clean: Column, parts: Column, terms: Column, most: int, characters: int) -> Column:
    def scored(s: Column, i: Column) -> Column:
        both = F.struct(F.lower(s).alias("low"), F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0))).alias("own"))
        score = lambda b: F.size(F.array_intersect(terms, b["own"])) + F.when(F.exists(terms, lambda t: F.contains(b["low"], t)), 0.2).otherwise(0.0)
        return let(both, lambda b: F.struct((-score(b)).alias("minus"), i.alias("i"), (F.size(b["own"]) >= 4).alias("long"), s.alias("s")))

    def chosen(every: Column) -> Column:
        long = F.filter(every, lambda x: x["long"])
        alike = F.transform(every, lambda x: F.struct(F.lit(0.0).alias("minus"), x["i"].alias("i"), x["long"].alias("long"), x["s"].alias("s")))
        best = F.slice(F.sort_array(F.when(F.size(long) > 0, long).otherwise(alike)), 1, most)
        in_order = F.sort_array(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        return F.array_join(F.transform(in_order, lambda x: x["s"]), " ")

    joined = strip(let(F.transform(parts, scored), chosen))
    return F.when(F.size(parts) == 0, F.substring(strip(clean), 1, characters)).otherwise(strip(F.substring(joined, 1, characters)))


# The prompts.
GROUNDED_SYSTEM = "You are a grounded question answering assistant. Use only the provided context. Give a concise but complete answer containing the information needed to resolve the question. Do not explain your reasoning or add citations. If the answer is not fully supported, reply with exactly 'unanswerable'."
GROUNDED_USER = "Answer the following question using only the context.\n\nQuestion: {q}\n\nContext passages:\n{c}\n\nReturn only the final answer."
OPEN_SYSTEM = "You are a concise question answering assistant. Return a complete answer with no explanation."
OPEN_USER = "Question: {q}\n\nReturn only the final answer."
SPAN_SYSTEM = "You are an extractive question answering assistant. Use only the provided context. Copy the shortest answer span supported by the context. Do not explain your reasoning. If the answer is not fully supported, reply with exactly 'unanswerable'."
SPAN_USER = "Answer the following question using only the context.\n\nQuestion: {q}\n\nContext passages:\n{c}\n\nReturn only the answer text with no explanation."
SHORT_SYSTEM = "You are a concise question answering assistant. Return only a short answer phrase with no explanation."
SHORT_USER = "Question: {q}\n\nReturn only the answer text."
PLAIN_PROMPT = "Answer the question using only the provided context. If the answer is not supported by the context, answer with 'unanswerable'.\n\nQuestion: {q}\n\nContext:\n{c}\n\nAnswer:"
PLAIN_OPEN = "Answer the question as briefly as possible.\n\nQuestion: {q}\n\nAnswer:"
CHAT_LEAD = "You are a helpful, concise assistant.\nRespond naturally to greetings and short chat messages.\nIf the user's message is unclear, ask a brief clarifying question instead of saying unanswerable.\n\nConversation:"
REFINE_SYSTEM = "You compress draft answers into the shortest exact answer span. Use the draft answer and the provided context. Return only the minimal answer phrase. If the draft answer is unsupported, reply with exactly 'unanswerable'."
PAIR = "<Instruct>: {i}\n<Query>: {q}\n<Document>: {d}"
PAIR_BEFORE = '<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
PAIR_AFTER = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
CONTEXT_PLACE = "<RETRIEVED_CONTEXT>"


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} as the column's value."""
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def qa_messages(question: Column, context: Column | None, style: str = "complete") -> Column:
    """array<struct<role, content>>; style 'complete' or 'extractive', with or without a context."""
    if style not in ("complete", "extractive"):
        raise ValueError(f"Unsupported answer style: {style}")
    grounded, ungrounded = ((GROUNDED_SYSTEM, GROUNDED_USER), (OPEN_SYSTEM, OPEN_USER)) if style == "complete" else ((SPAN_SYSTEM, SPAN_USER), (SHORT_SYSTEM, SHORT_USER))
    if context is None:
        return messages(ungrounded[0], fill(ungrounded[1], q=question))
    return messages(grounded[0], fill(grounded[1], q=question, c=context))


def qa_prompt(question: Column, context: Column | None) -> Column:
    return fill(PLAIN_OPEN, q=question) if context is None else fill(PLAIN_PROMPT, q=question, c=context)


def chat_prompt(turns: Column) -> Column:
    """Turns of array<struct<role, content>> as lines `Role: content`; empty ones go."""
    said = F.filter(turns, lambda t: strip(t["content"]) != "")
    told = F.transform(said, lambda t: F.concat(F.upper(F.substring(strip(t["role"]), 1, 1)), F.lower(F.substring(strip(t["role"]), 2, 1_000_000)), F.lit(": "), strip(t["content"])))
    return F.array_join(F.concat(F.array(F.lit(CHAT_LEAD)), told, F.array(F.lit("Assistant:"))), "\n")


def refinement_messages(question: Column, draft: Column, context: Column | None) -> Column:
    block = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) == "", "").otherwise(F.concat(F.lit("Context passages:\n"), context, F.lit("\n\n")))
    return messages(REFINE_SYSTEM, F.concat(F.lit("Question: "), question, F.lit("\n\n"), block, F.lit("Draft answer: "), draft, F.lit("\n\nReturn only the final answer phrase.")))


def pair_text(question: Column, document: Column, instruction: Column) -> Column:
    """The rendered query-document pair of the scorer."""
    return F.concat(F.lit(PAIR_BEFORE), fill(PAIR, i=instruction, q=question, d=document), F.lit(PAIR_AFTER))


def prompt_hash(question: Column) -> Column:
    """The hash of the prompt with a mark in place of the context, as JSON with sorted keys.

    Equal to hashing the text that a JSON writer gives for questions of printable ASCII.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    entry = lambda role, c: F.concat(F.lit('{"content": '), quoted(c), F.lit(f', "role": "{role}"}}'))
    text = F.concat(F.lit("["), entry("system", F.lit(GROUNDED_SYSTEM)), F.lit(", "), entry("user", fill(GROUNDED_USER, q=question, c=F.lit(CONTEXT_PLACE))), F.lit("]"))
    return F.sha2(text, 256)


def context_of(texts: Column) -> Column:
    """`[i] text` joined by a blank line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")


def pack(tokens: Column, overhead: Column, budget: int) -> dict[str, Column]:
    """The longest prefix of the context's tokens that fits the budget beside the rest of the prompt.

    With a reversible tokenizer the search for it has a closed form. A prompt that doesn't fit without any context fails.
    """
    room = F.lit(budget) - overhead
    room = F.when(room < 0, F.raise_error(F.lit("Question and fixed prompt exceed the input budget"))).otherwise(room)
    used = F.least(F.size(tokens), room)
    return {"packed": F.array_join(F.slice(tokens, 1, used), " "), "full_tokens": F.size(tokens) + overhead, "used_tokens": used + overhead, "truncated": F.size(tokens) > room}

