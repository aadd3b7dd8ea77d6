"""What a request to a model server has to fulfil, its defaults, and counters in the text format for metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and limits, and the wording of the messages below, which clients compare.
MAX_TOKENS = {True: 512, False: 16}
MAX_INPUTS = 2048
TEMPERATURE, TOP_P = (0.0, 100.0), 1.0


def with_defaults(requests: DataFrame, chat: bool) -> DataFrame:
    """`requests` with temperature, top_p and max_tokens (one at least) where they are null; chat and plain ones differ in max_tokens."""
    most = F.greatest(F.coalesce(F.col("max_tokens"), F.lit(MAX_TOKENS[chat])), F.lit(1)).cast("long")
    return requests.withColumns({"temperature": F.coalesce("temperature", F.lit(1.0)), "top_p": F.coalesce("top_p", F.lit(1.0)), "max_tokens": most})


def _sampling_error() -> Column:
    low, high = TEMPERATURE
    wrong = ~F.col("temperature").between(low, high) | (F.col("top_p") <= 0) | (F.col("top_p") > TOP_P)
    return F.when(F.coalesce(F.col("n"), F.lit(1)) != 1, "only n = 1 is supported").when(wrong, "temperature must be in [0, 100] and top_p in (0, 1]")


def chat_error() -> Column:
    """Null for a chat request (messages: array of role and content, n, temperature, top_p) that can be served."""
    m = F.col("messages")
    first = F.when(m.isNull(), "missing messages").when(F.size(m) == 0, "messages is empty")
    first = first.when(F.exists(m, lambda x: x["role"].isNull()), "message without role").when(F.exists(m, lambda x: x["content"].isNull()), "message without content")
    return F.coalesce(first, _sampling_error())


def completion_error() -> Column:
    """Null for a completion request (prompt, or token ids in prompt_ids; n, temperature, top_p) that can be served."""
    none = F.col("prompt").isNull() & (F.col("prompt_ids").isNull() | F.exists("prompt_ids", lambda x: x.isNull() | (x < 0)))
    return F.coalesce(F.when(none, "prompt must be a string or an array of token ids"), _sampling_error())


def admission_error(tokens: Column, most: int, vocabulary: int) -> Column:
    """Null for prompt tokens that fit: one at least, fewer than `most`, all of the vocabulary."""
    n = F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0))
    outside = F.get(F.filter(tokens, lambda x: x >= vocabulary), 0)
    length = F.concat(F.lit("prompt of "), n.cast("string"), F.lit(f" tokens; this server fits 1 to {most - 1}"))
    return F.when((n == 0) | (n >= most), length).when(outside.isNotNull(), F.concat(F.lit("token "), outside.cast("string"), F.lit(" is outside the vocabulary")))


def embedding_error(inputs: Column, form: Column) -> Column:
    """Null for inputs (array of strings) of an embedding request in the form float (default) or base64."""
    return (
        F.when(inputs.isNull() | F.exists(inputs, lambda x: x.isNull()), "input must be a string or an array of strings")
        .when(F.size(inputs) == 0, "input must not be empty")
        .when(F.size(inputs) > MAX_INPUTS, f"at most {MAX_INPUTS} inputs per request")
        .when(~F.coalesce(form, F.lit("float")).isin("float", "base64"), F.concat(F.lit('unsupported encoding_format "'), form, F.lit('"')))
    )


def greedy(temperature: Column) -> Column:
    """Whether the likeliest token is taken instead of a draw."""
    return temperature <= 0


def collected(requests: DataFrame, events: DataFrame, by: list[str], stopped: Column | None = None) -> DataFrame:
    """`requests` (`by`) and `events` (`by`, seq, token, finish: null but for a closing event) to (`by`, tokens, finish).

    Tokens are those before the first closing event, in order of seq; later ones don't count. A request without a closing event was cancelled. One for which
    `stopped` holds came when no engine ran: it is rejected, whatever events it has. Requests have bounded numbers of tokens; other requests' events are ignored.
    """
    closing = F.min(F.when(F.col("finish").isNotNull(), F.struct("seq", "finish")))
    listed = F.array_sort(F.collect_list(F.when(F.col("finish").isNull() & F.col("token").isNotNull(), F.struct("seq", "token"))))
    found = events.groupBy(*by).agg(closing.alias("_end"), listed.alias("_all"))
    kept = F.filter("_all", lambda x: F.col("_end").isNull() | (x["seq"] < F.col("_end.seq")))
    found = found.select(*by, F.transform(kept, lambda x: x["token"]).alias("_tokens"), F.col("_end.finish").alias("_finish"))
    gone = F.coalesce(stopped, F.lit(False)) if stopped is not None else F.lit(False)
    rows = requests.select(*by, gone.alias("_gone")).join(found, by, "left")
    none = F.array().cast(found.schema["_tokens"].dataType)
    tokens = F.when(F.col("_gone") | F.col("_tokens").isNull(), none).otherwise(F.col("_tokens"))
    return rows.select(*by, tokens.alias("tokens"), F.when(F.col("_gone"), "rejected: engine stopped").otherwise(F.coalesce("_finish", F.lit("cancelled"))).alias("finish"))


def metric_lines(rows: DataFrame, labels: dict[str, str], series: list[str], prefix: str = "") -> DataFrame:
    """`rows` to (series, line): a line of the text format for each series and row, with labels from columns."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', '\\\\"')
    marks = F.concat_ws(",", *[F.concat(F.lit(f'{name}="'), quoted(c), F.lit('"')) for name, c in labels.items()])
    head = F.concat(F.lit("{"), marks, F.lit("} ")) if labels else F.lit(" ")
    each = F.array(*[F.struct(F.lit(x).alias("series"), F.concat(F.lit(prefix + x), head, F.col(x).cast("string")).alias("line")) for x in series])
    return rows.select(F.explode(each).alias("x")).select("x.*")
