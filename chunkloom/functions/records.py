"""Expressions for JSON payloads, numbers, time and identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chunkloom import constants as K
from chunkloom.functions.text import strip, strip_think_tags

TEXT_PART_TYPES = ("text", "output_text", "input_text")


def safe_int(value: Column) -> Column:
    return F.nullif(value, F.lit("")).try_cast("long")


def safe_float(value: Column) -> Column:
    return F.nullif(value, F.lit("")).try_cast("double")


def decode_json_map(text: Column) -> Column:
    """JSON object to a string map; null, blank or broken text gives an empty map."""
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def json_number(text: Column, field: str) -> Column:
    """Numeric member of a JSON object, null when absent, not numeric or the text is broken."""
    return safe_float(F.get_json_object(text, f"$.{field}"))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed_ms(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.floor(micros / 1000).cast("long"))


def is_timeout(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("timeout|timed out")


def token_cost(tokens: Column, price_per_1k: float) -> Column:
    return F.coalesce(tokens, F.lit(0)) * F.lit(float(price_per_1k)) / F.lit(1000.0)


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding that ignores the last bits, so that 2.45 computed as 2.4499999999 is 2.5."""
    return F.round(F.round(value, 6 if digits < 5 else 12), digits)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded share; null over an empty base."""
    return F.round(F.when(whole > 0, part / whole), digits)


def sanitize_identity(value: Column) -> Column:
    """Letters, digits and ``-_.@`` kept, all else underscore, 80 bytes, never empty."""
    bytes_as_chars = F.decode(F.encode(F.coalesce(value, F.lit("")), "UTF-8"), "ISO-8859-1")
    clean = F.substring(F.regexp_replace(bytes_as_chars, r"[^A-Za-z0-9\-_.@]", "_"), 1, 80)
    return F.when(clean == "", F.lit("unknown")).otherwise(clean)


def client_ip(forwarded_for: Column, real_ip: Column, peer: Column, trusted: Column) -> Column:
    first = F.nullif(F.trim(F.split_part(F.coalesce(forwarded_for, F.lit("")), F.lit(","), F.lit(1))), F.lit(""))
    second = F.nullif(F.trim(F.coalesce(real_ip, F.lit(""))), F.lit(""))
    return F.when(trusted, F.coalesce(first, second, peer)).otherwise(peer)


def flatten_content(content: Column) -> Column:
    """Text of a message content (a variant): a string as it is, or typed parts and plain values of a list put together."""
    kind = F.schema_of_variant

    def one(item):
        typed = F.try_variant_get(item, "$.type", "string").isin(*TEXT_PART_TYPES)
        text = F.when(typed, F.try_variant_get(item, "$.text", "string"))
        plain = F.when(~kind(item).startswith("OBJECT"), F.try_variant_get(item, "$", "string"))
        return F.coalesce(F.when(kind(item).startswith("OBJECT"), text).otherwise(plain), F.lit(""))

    parts = F.array_join(F.transform(F.try_variant_get(content, "$", "array<variant>"), one), "")
    return F.when(kind(content).startswith("ARRAY"), parts).otherwise(F.try_variant_get(content, "$", "string"))


def answer_content(response: Column) -> Column:
    """Content of the first choice as a variant: its message's, else its text; null when both are missing or null."""
    body = F.try_parse_json(response)
    found = [F.try_variant_get(body, path, "variant") for path in ("$.choices[0].message.content", "$.choices[0].text")]
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in found])


def extract_answer(response: Column) -> Column:
    """First choice's text without think tags, with the reason when there is none."""
    content = answer_content(response)
    answer = strip_think_tags(flatten_content(content))
    has_choice = F.try_variant_get(F.try_parse_json(response), "$.choices[0]", "variant").isNotNull()
    error = (
        F.when(~has_choice, F.lit("llm response missing choices"))
        .when(content.isNull(), F.lit("llm response missing answer content"))
        .when(answer == "", F.lit("llm response answer is empty"))
    )
    return F.struct(F.when(error.isNull(), answer).alias("answer"), error.alias("error"))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1))


def sanitize_file_name(name: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[/\\:*?"<>|]', "_")
    return F.when(clean == "", F.lit(K.EMPTY_FILE_NAME)).otherwise(clean)


def stripped_or_empty(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))
