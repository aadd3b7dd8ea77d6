"""Text functions as expressions: normal forms, splits, prompts, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The split patterns of three tokenizer families, with white space as in Unicode.
_SPACE = r"[\t-\r \x85\p{Z}]"
_SOLID = r"[^\t-\r \x85\p{Z}]"
GPT2 = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\t-\r \x85\p{{Z}}\p{{L}}\p{{N}}]+|{_SPACE}+(?!{_SOLID})|{_SPACE}+"
_CONTRACTION = r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]"


def _modern(digits: str) -> str:
    other = r" ?[^\t-\r \x85\p{Z}\p{L}\p{N}]+[\r\n]*"
    return rf"{_CONTRACTION}|[^\r\n\p{{L}}\p{{N}}]?\p{{L}}+|{digits}|{other}|{_SPACE}*[\r\n]+|{_SPACE}+(?!{_SOLID})|{_SPACE}+"


LLAMA3 = _modern(r"\p{N}{1,3}")
QWEN2 = _modern(r"\p{N}")

DEFAULT_SYSTEM = "You are a helpful assistant."


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gpt2_split(text: Column) -> Column:
    return _pieces(text, GPT2)


def llama3_split(text: Column) -> Column:
    return _pieces(text, LLAMA3)


def qwen2_split(text: Column) -> Column:
    return _pieces(text, QWEN2)


def digits_split(text: Column, each: bool = False) -> Column:
    """Runs of numeric characters, or each of them, and what stands between."""
    return _pieces(text, r"\p{N}|[^\p{N}]+" if each else r"\p{N}+|[^\p{N}]+")


def byte_level(text: Column, prefix_space: bool = False, split: bool = True) -> Column:
    if prefix_space:
        text = F.when(text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text))
    return gpt2_split(text) if split else F.array(text)


def trimmed(text: Column) -> Column:
    """Without white space, as in Unicode, at both ends."""
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def words(text: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(text, rf"{_SPACE}+"), lambda w: w != "")


def answer_normal_form(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, words joined by single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin("a", "an", "the")), " ")


def first_line(text: Column) -> Column:
    """The first line of what is left after trimming, trimmed."""
    return trimmed(F.element_at(F.split(trimmed(text), "\n"), 1))


def with_instruction(prefix: str, query: Column) -> Column:
    return F.concat(F.lit(prefix), query)


def turns(turn: Column, role: Column, text: Column) -> Column:
    """Aggregate of a conversation's messages in order: ARRAY<STRUCT<turn, role, text>>."""
    return F.array_sort(F.collect_list(F.struct(turn.alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))))


def chatml(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """A default system turn comes first if the conversation starts otherwise."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), "")
    lead = F.when(F.coalesce(F.get(messages, 0)["role"] == "system", F.lit(False)), "").otherwise(f"<|im_start|>system\n{system}<|im_end|>\n")
    return F.concat(lead, body, F.lit("<|im_start|>assistant\n"))


def llama3_chat(messages: Column, begin: bool = True) -> Column:
    head = lambda role: F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))
    body = F.array_join(F.transform(messages, lambda m: F.concat(head(m["role"]), trimmed(m["text"]), F.lit("<|eot_id|>"))), "")
    return F.concat(F.lit("<|begin_of_text|>" if begin else ""), body, head(F.lit("assistant")))


def plain_chat(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["text"], F.lit("\n\n"))), "")


def chat_format(template: Column) -> Column:
    """chatml, llama3 or plain, by the marks in a chat template."""
    return F.when(template.contains("<|im_start|>"), "chatml").when(template.contains("<|start_header_id|>"), "llama3").otherwise("plain")


def default_system(template: Column) -> Column:
    """The system text that a chatml template writes out itself: what stands between the marks of a system turn, not empty and without signs of
    code; null without one. Templates that break the line count before those that spell the break as an escape."""

    def first(mark: str) -> Column:
        turn = rf"(?s)<\|im_start\|>system{mark}(?=(.*?)<\|im_end\|>)"
        found = F.regexp_extract_all(template, F.lit(turn), F.lit(1))
        return F.get(F.filter(found, lambda x: (x != "") & ~x.rlike(r"[{'+]")), 0)

    return F.coalesce(first(r"\n"), first(r"\\n"))


def templated(messages: Column, template: Column) -> Column:
    """The prompt of messages in the format that a template shows; a chatml one has a leading system turn only if it names its text."""
    bare = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    led = F.coalesce(F.get(bare, 0)["role"] == "system", F.lit(False)) | default_system(template).isNull()
    full = F.when(led, bare).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), default_system(template).alias("text"))), bare))
    turns_ = F.concat(F.array_join(F.transform(full, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), ""), F.lit("<|im_start|>assistant\n"))
    kind = chat_format(template)
    return F.when(kind == "chatml", turns_).when(kind == "llama3", llama3_chat(bare)).otherwise(plain_chat(bare))


# Tokens that end an answer, by format.
STOPS = {"chatml": ["<|im_end|>"], "llama3": ["<|eot_id|>", "<|eom_id|>"], "plain": []}


def grounded_prompt(question: Column, passages: Column) -> Column:
    """The question after numbered passages; alone without any."""
    numbered = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p, F.lit("\n\n"))), "")
    return F.when(F.size(passages) > 0, F.concat(F.lit("Answer from the passages.\n\n"), numbered, F.lit("Question: "), question)).otherwise(F.concat(F.lit("Question: "), question))


def one_shot(question: Column, passages: Column) -> Column:
    """Messages for a question: how to answer, one worked example, and the question after its passages."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("text"))
    example = F.lit("Answer from the passages.\n\n[1] The bridge was opened in May 1931.\n\nQuestion: When was the bridge opened?")
    return F.array(said("system", F.lit("Answer with the shortest span of the passages that answers the question.")), said("user", example), said("assistant", F.lit("May 1931")), said("user", grounded_prompt(question, passages)))


def size_bytes(literal: Column) -> Column:
    """`1G`, `256M`, `8K` or a plain number, powers of 1024; null if it isn't one."""
    unit = F.upper(F.substring(literal, -1, 1))
    factor = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1)
    number = F.regexp_replace(literal, "[GgMmKk]$", "")
    return F.floor(number.try_cast("double") * factor).cast("long")


def range_bounds(literal: Column) -> Column:
    """`a..b` as STRUCT<low, high>; a single value is both."""
    parts = F.split(literal, r"\.\.")
    return F.struct(F.element_at(parts, 1).try_cast("long").alias("low"), F.element_at(parts, -1).try_cast("long").alias("high"))


def until_stop(text: Column, stops: list[str]) -> Column:
    """The text before the earliest of the stop strings."""
    at = F.least(*[F.when(F.instr(text, s) > 0, F.instr(text, s)).otherwise(F.lit(2147483647)) for s in stops], F.length(text) + 1)
    return F.substring(text, F.lit(1), at - 1)


def sse(payload: Column) -> Column:
    """A server-sent event of one line."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def sse_stream(payloads: Column) -> Column:
    """The events of an array of payloads and the closing mark."""
    return F.concat(F.array_join(F.transform(payloads, sse), ""), sse(F.lit("[DONE]")))


def without_special(ids: Column, special: list[int]) -> Column:
    return F.filter(ids, lambda x: ~x.isin(special))
