"""Model completions to commit messages: extraction, validation, formatting, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import text as T

# Allowed commit types and the one that replaces any other.
ALLOWED_TYPES = ["feat", "fix", "docs", "style", "refactor", "test", "chore"]
DEFAULT_TYPE = "feat"

# Sampling limits.
TEMPERATURE = (0.01, 0.6)
TOP_P = (0.01, 0.95)
REGENERATE_STEP = 0.05
REGENERATE_MIN = 0.1

# Patterns of the JSON object in a completion, fenced or bare.
FENCED = r"(?i)```(?:json)?\s*(\{[\s\S]*?\})\s*```"
# The last opening brace up to the next closing one.
LAST_OBJECT = r"(\{[^{}]*\})[^{]*$"

MESSAGE = "type STRING, scope STRING, description STRING, body STRING"
MAX_RETRIES = 1


def json_text(completion: Column) -> Column:
    """The JSON object of a completion: fenced, else the last braces, else NULL."""
    return F.coalesce(T.pick(completion, FENCED), T.pick(completion, LAST_OBJECT))


def extract_json(completions: DataFrame) -> DataFrame:
    return completions.withColumn("json", json_text(F.col("completion")))


def parse_completion(extracted: DataFrame, attempt: int = 0) -> DataFrame:
    """Typed fields and ``outcome``: parsed, extraction failed or invalid record.

    ``type`` and ``description`` must be strings, ``scope`` and ``body`` strings or null.
    """
    tree = F.try_parse_json("json")

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("tree", f"$.{field}", "variant"))

    def required(field: str) -> Column:
        return F.coalesce(kind(field) == "STRING", F.lit(False))

    def optional(field: str) -> Column:
        return F.coalesce(kind(field).isin("STRING", "VOID"), F.lit(True))

    valid = F.coalesce(F.schema_of_variant("tree").startswith("OBJECT"), F.lit(False)) & required("type")
    valid = valid & required("description") & optional("scope") & optional("body")
    outcome = (
        F.when(F.col("json").isNull(), F.lit("extraction failed"))
        .when(F.col("valid"), F.lit("parsed"))
        .otherwise(F.lit("invalid record"))
    )
    message = F.when(F.col("valid"), F.from_json("json", MESSAGE))
    return (
        extracted.withColumn("tree", tree)
        .withColumn("valid", valid)
        .withColumn("message", message)
        .withColumn("outcome", outcome)
        .select(*extracted.columns, "outcome", F.lit(attempt).cast("bigint").alias("attempt"), "message.*")
    )


def retry_queue(parsed: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failed completions with tries left, for another round of the outside service."""
    failed = parsed.where((F.col("outcome") != "parsed") & (F.col("attempt") < max_retries))
    return failed.select("conv_id", "turn", "completion", "outcome", (F.col("attempt") + 1).alias("attempt"))


def one_per_try(answers: DataFrame) -> DataFrame:
    """Answers without repeated deliveries; of different texts for one try, the one of least hash counts.

    Only numbers are aggregated, so wide texts are not sorted.
    """
    keys = ["conv_id", "turn", "attempt"]
    marked = answers.select(*keys, "completion", F.xxhash64("completion").alias("mark")).distinct()
    chosen = marked.groupBy(*keys).agg(F.min("mark").alias("mark"))
    return marked.join(chosen, [*keys, "mark"]).drop("mark")


def _finished(max_retries: int) -> Column:
    return (F.col("outcome") == "parsed") | (F.col("attempt") >= max_retries)


def next_round(ledger: DataFrame, answers: DataFrame, attempt: int, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The ledger after the answers of one more try; requests that are final or got no answer stay as they are.

    Answers are judged before they meet the ledger, and those that nobody waits for meet no row of it.
    """
    fields = ["completion", "json", "outcome", "attempt", "type", "scope", "description", "body"]
    tries = one_per_try(answers.where(F.col("attempt") == attempt)).drop("attempt")
    judged = parse_completion(extract_json(tries), attempt).select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.struct(*fields).alias("_new")
    )
    waiting = ~F.col("final") & (F.col("attempt") == attempt - 1)
    met = ledger.join(judged, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & waiting, "left")
    answered = F.col("_new").isNotNull()
    new = {c: F.when(answered, F.col("_new")[c]).otherwise(F.col(c)) for c in fields}
    others = [c for c in ledger.columns if c not in (*fields, "final")]
    return met.select(*others, *[v.alias(c) for c, v in new.items()]).withColumn("final", _finished(max_retries))


def ledger(completions: DataFrame, answers: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """One row per request with its last judged try; ``final`` is false where a further answer is still to come.

    ``answers`` (conv_id, turn, attempt, completion) holds all later tries that have arrived. A request is parsed by
    its first valid answer; later ones do not count, nor do tries beyond ``max_retries``.
    """
    first = parse_completion(extract_json(completions))
    out = first.withColumn("final", _finished(max_retries))
    for attempt in range(1, max_retries + 1):
        out = next_round(out, answers, attempt, max_retries)
    return out


def retried_messages(completions: DataFrame, answers: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The whole chain with every try that arrived: message and outcome of each request's last try."""
    return format_message(normalise_type(ledger(completions, answers, max_retries)))


def normalise_type(parsed: DataFrame) -> DataFrame:
    kept = F.when(F.col("type").isin(ALLOWED_TYPES), F.col("type")).when(F.col("type").isNotNull(), F.lit(DEFAULT_TYPE))
    return parsed.withColumn("invalid_type", ~F.col("type").isin(ALLOWED_TYPES)).withColumn("type", kept)


def format_message(normalised: DataFrame) -> DataFrame:
    """Adds ``commit_message`` and turns a blank description into its own outcome."""
    description = T.strip(F.col("description"))
    body = T.no_empty(T.strip(F.col("body")))
    header = F.concat(
        F.col("type"),
        F.when(F.coalesce(F.col("scope"), F.lit("")) != "", F.concat(F.lit("("), F.col("scope"), F.lit(")"))).otherwise(
            F.lit("")
        ),
        F.lit(": "),
        description,
    )
    blank = (F.col("outcome") == "parsed") & (description == "")
    text = F.concat(header, F.coalesce(F.concat(F.lit("\n\n"), body), F.lit("")))
    return normalised.withColumn("outcome", F.when(blank, F.lit("blank description")).otherwise(F.col("outcome"))).withColumn(
        "commit_message", F.when(F.col("outcome") == "parsed", text)
    )


def messages(completions: DataFrame) -> DataFrame:
    """The whole chain from completion to message."""
    return format_message(normalise_type(parse_completion(extract_json(completions))))


def outcomes(formatted: DataFrame) -> DataFrame:
    """Count per outcome; a replaced type counts apart from other successes."""
    outcome = F.when((F.col("outcome") == "parsed") & F.col("invalid_type"), F.lit("parsed, type replaced")).otherwise(
        F.col("outcome")
    )
    return formatted.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def clamp_params(params: DataFrame, regenerate: bool = False) -> DataFrame:
    """Sampling parameters inside their limits; ``valid`` is false for NaN or infinite input."""
    def finite(c: str) -> Column:
        return ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))

    temperature = F.col("temperature")
    if regenerate:
        temperature = F.greatest(
            F.least(temperature + REGENERATE_STEP, F.lit(TEMPERATURE[1])), F.lit(REGENERATE_MIN)
        )
    valid = F.coalesce(finite("temperature") & finite("top_p"), F.lit(False))

    def clamp(value: Column, limits: tuple[float, float]) -> Column:
        return F.when(F.col("valid"), F.greatest(F.least(value, F.lit(limits[1])), F.lit(limits[0])))

    out = params.withColumn("valid", valid)
    return out.withColumns(
        {
            "temperature": clamp(temperature, TEMPERATURE),
            "top_p": clamp(F.col("top_p"), TOP_P),
            "num_return_sequences": F.greatest(F.col("num_return_sequences"), F.lit(1)),
        }
    )


def add_trailers(texts: DataFrame, trailers: DataFrame) -> DataFrame:
    """Messages with issue and breaking-change lines where given."""
    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    tail = F.concat(
        F.when(given("issue_refs"), F.concat(F.lit("Fixes: "), F.col("issue_refs"), F.lit("\n"))).otherwise(F.lit("")),
        F.when(
            given("breaking_desc"), F.concat(F.lit("BREAKING CHANGE: "), F.col("breaking_desc"), F.lit("\n"))
        ).otherwise(F.lit("")),
    )
    trimmed = F.regexp_replace(F.col("message"), r"\s+$", "")
    full = F.when(tail != "", F.concat(trimmed, F.lit("\n\n"), tail)).otherwise(F.col("message"))
    return texts.join(trailers, "commit_id", "left").withColumn("message", full).drop("issue_refs", "breaking_desc")
