"""Text helpers shared by prompts, benchmarks and training rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIN = Column | str
WHITESPACE = " \t\n\r\x0b\x0c"
IMAGE_TOKEN = "<image>"

# Tokens removed from every query and answer, and the mark between answers.
ANSWER_SEPARATOR = "[!@#$NEXT!@#$]"
REMOVED_TOKENS = ["<|startoftext|>", "<|im_end|>", ANSWER_SEPARATOR]


def _c(x: CIN) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def strip(text: CIN) -> Column:
    return F.btrim(_c(text), F.lit(WHITESPACE))


def words(text: CIN) -> Column:
    return F.filter(F.split(_c(text), r"\s+"), lambda t: t != "")


def word_count(text: CIN) -> Column:
    return F.size(words(text)).cast("bigint")


def swap(text: CIN, old: str, new: str | Column) -> Column:
    return F.replace(_c(text), F.lit(old), new if isinstance(new, Column) else F.lit(new))


def swap_all(text: CIN, pairs: list[tuple[str, str]]) -> Column:
    out = _c(text)
    for old, new in pairs:
        out = swap(out, old, new)
    return out


def remove_tokens(text: CIN, tokens: list[str] = REMOVED_TOKENS) -> Column:
    return swap_all(text, [(t, "") for t in tokens])


def decimal_text(x: CIN, places: int = 4) -> Column:
    """Rounded number as text with at least one decimal: 0.5, 0.25, 1.0."""
    unit = 10**places
    n = F.round(_c(x) * float(unit)).cast("bigint")
    size = F.abs(n)
    digits = F.rtrim(F.lpad((size % unit).cast("string"), places, "0"), F.lit("0"))
    return F.concat(
        F.when(n < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(size / unit).cast("string"),
        F.lit("."),
        F.when(digits == "", F.lit("0")).otherwise(digits),
    )


def coordinates(*cols: CIN) -> Column:
    parts = [decimal_text(c) for c in cols]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def first_line(text: CIN) -> Column:
    return F.split(_c(text), "\n")[0]


def count_of(text: CIN, token: str) -> Column:
    return ((F.length(_c(text)) - F.length(swap(text, token, ""))) / len(token)).cast("bigint")


def cut_at(text: CIN, stop: CIN) -> Column:
    """Drop a trailing stop word."""
    text, stop = _c(text), (F.lit(stop) if isinstance(stop, str) else stop)
    return F.when(
        F.endswith(text, stop), F.left(text, F.length(text) - F.length(stop))
    ).otherwise(text)


def completion(text: CIN, prompt: CIN, role: CIN, sep: CIN) -> Column:
    """The answer inside a decoded text: after prompt and role header, up to the separator."""
    text, prompt, role, sep = _c(text), _c(prompt), _c(role), _c(sep)
    start = F.length(prompt) + F.length(role) + 2
    found = F.call_function("locate", sep, text, F.length(prompt) + 1)
    end = F.when(found > 0, found - 1).otherwise(F.length(text))
    return strip(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))))


def capped_input(text: CIN, has_image: CIN) -> Column:
    text, has_image = _c(text), _c(has_image)
    short = F.left(text, F.when(has_image, F.lit(1200)).otherwise(F.lit(1536)))
    return F.when(
        has_image & ~F.contains(short, F.lit(IMAGE_TOKEN)), F.concat(short, F.lit("\n" + IMAGE_TOKEN))
    ).otherwise(short)


def model_name(path: CIN) -> Column:
    parts = F.split(F.btrim(_c(path), F.lit("/")), "/")
    last = F.element_at(parts, -1)
    return F.when(
        last.startswith("checkpoint-"), F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("_"), last)
    ).otherwise(last)


def token_budget(requested: CIN, context: CIN, prompt_tokens: CIN, image_tokens: CIN) -> Column:
    """Tokens left for the answer; NULL when the prompt already fills the context."""
    left = F.least(
        F.least(_c(requested), F.lit(1024)), _c(context) - _c(prompt_tokens) - _c(image_tokens)
    )
    return F.when(left >= 1, left)


def template_for_model(name: CIN, marker: str = "vision") -> Column:
    """Conversation template for a model name; ``marker`` is the part of a name that tells the
    vision models. The templates are called ``vision_…`` whatever the marker.

    ``mistral_orca`` and ``mpt_text`` name templates that do not exist; rows that get them
    have no partner in the template table and end up among the rejects.
    """
    raw = _c(name)
    n = F.lower(raw)
    has = lambda s: F.contains(n, F.lit(s))
    tagged = has("mmtag") | (has("plain") & ~has("finetune"))
    vision = (
        F.when(has("llama-2"), "vision_llama_2")
        .when((has("mistral") | has("mixtral")) & has("orca"), "mistral_orca")
        .when((has("mistral") | has("mixtral")) & has("hermes"), "chatml_direct")
        .when(has("mistral") | has("mixtral"), "mistral_instruct")
        .when(has(f"{marker}-v1.6-34b"), "chatml_direct")
        .when(has("v1") & tagged, "v1_mmtag")
        .when(has("v1"), "vision_v1")
        .when(has("mpt"), "mpt")
        .when(tagged, "v0_mmtag")
        .otherwise("vision_v0")
    )
    return (
        F.when(has(marker), vision)
        .when(F.contains(raw, F.lit("mpt")), "mpt_text")
        .when(F.contains(raw, F.lit("llama-2")), "llama_2")
        .otherwise("vicuna_v1")
    )
