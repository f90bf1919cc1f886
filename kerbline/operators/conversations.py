"""Conversations to prompts: role checks, image tokens, templates, rendering.

``turns(conv_id, turn, role, text)``; roles are ``human`` and ``gpt`` (``normalise_roles``
maps others). Work per turn stays one row per turn, whatever the length of a conversation;
only the last step writes one text per conversation, which is then a single cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompt_texts as P
from ..functions import text as X

BLOCK = 1024  # turns per join block


def normalise_roles(turns: DataFrame, human: str = "user", gpt: str = "assistant") -> DataFrame:
    role = F.when(F.col("role") == human, "human").when(F.col("role") == gpt, "gpt").otherwise(F.col("role"))
    return turns.withColumn("role", role)


def _attach(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """Join per-conversation facts (with ``t_min, t_max``) on (conversation, block of turns)."""
    blocks = facts.withColumn(
        "_blk",
        F.explode(F.sequence(F.floor(F.col("t_min") / BLOCK), F.floor(F.col("t_max") / BLOCK))),
    ).drop("t_min", "t_max")
    return turns.withColumn("_blk", F.floor(F.col("turn") / BLOCK)).join(blocks, ["conv_id", "_blk"]).drop("_blk")


def index_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: drop a leading turn that is not human, number the rest from 0.

    Turn numbers must run without gaps or repeats and roles must alternate; conversations that break
    this, or that are empty after the drop, go to ``rejects(conv_id, reason)``.
    """
    at = lambda role, parity: F.count_if((F.col("role") == role) & (F.pmod("turn", F.lit(2)) == parity))
    facts = turns.groupBy("conv_id").agg(
        F.min("turn").alias("t_min"),
        F.max("turn").alias("t_max"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("turn").alias("n_turns"),
        F.min_by("role", "turn").alias("first_role"),
        *[at(role, p).alias(f"{role}{p}") for role in ("human", "gpt") for p in (0, 1)],
    )
    facts = facts.withColumn("t0", F.col("t_min") + F.when(F.col("first_role") == "human", 0).otherwise(1))
    # alternation from counts: humans on the parity of t0, gpt on the other, nothing else
    even_start = F.pmod("t0", F.lit(2)) == 0
    n_human = F.when(even_start, F.col("human0")).otherwise(F.col("human1"))
    n_gpt = F.when(even_start, F.col("gpt1")).otherwise(F.col("gpt0"))
    dropped_gpt = F.when((F.col("t0") > F.col("t_min")) & (F.col("first_role") == "gpt"), 1).otherwise(0)
    size, size_all = F.col("t_max") - F.col("t0") + 1, F.col("t_max") - F.col("t_min") + 1
    alternates = (n_human == F.ceil(size / 2)) & (n_gpt - dropped_gpt == F.floor(size / 2))
    judged = facts.withColumn(
        "reason",
        F.when((size_all != F.col("n")) | (F.col("n_turns") != F.col("n")), "gap in turns")
        .when(F.col("t0") > F.col("t_max"), "no human turn")
        .when(~alternates, "roles do not alternate"),
    )
    good = judged.filter("reason is null").select("conv_id", "t_min", "t_max", "t0")
    indexed = (
        _attach(turns, good).withColumn("i", F.col("turn") - F.col("t0")).filter("i >= 0").drop("t0")
    )
    return indexed, judged.filter("reason is not null").select("conv_id", "reason")


def move_image_token(text: Column | str, tagged: bool = False, start_end: tuple[str, str] | None = None) -> Column:
    """Bring ``<image>`` to the front of a turn that has it, with optional tags around it."""
    raw = F.col(text) if isinstance(text, str) else text
    token = X.IMAGE_TOKEN
    moved = X.strip(F.concat(F.lit(token + "\n"), X.strip(X.swap(raw, token, ""))))
    if tagged:
        moved = X.swap(moved, token, f"<Image>{token}</Image>")
    out = F.when(F.contains(raw, F.lit(token)), moved).otherwise(raw)
    return X.swap(out, token, start_end[0] + token + start_end[1]) if start_end else out


def place_image(indexed: DataFrame, has_image: Column, tagged: bool = False) -> DataFrame:
    """Opening message with a picture: ``<image>`` in front, or as its own exchange if tagged."""
    bare = X.strip(X.swap("text", X.IMAGE_TOKEN, ""))
    opening = (F.col("i") == 0) & has_image
    if not tagged:
        return indexed.withColumn(
            "text", F.when(opening, F.concat(F.lit(X.IMAGE_TOKEN + "\n"), bare)).otherwise(F.col("text"))
        )
    shifted = indexed.withColumn("text", F.when(opening, bare).otherwise(F.col("text"))).withColumn(
        "i", F.when(has_image, F.col("i") + 2).otherwise(F.col("i"))
    )
    lead = (
        indexed.filter(opening)
        .withColumn(
            "_m",
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("i"), F.lit("human").alias("role"), F.lit(f"<Image>{X.IMAGE_TOKEN}</Image>").alias("text")),
                    F.struct(F.lit(1).alias("i"), F.lit("gpt").alias("role"), F.lit("Received.").alias("text")),
                )
            ),
        )
        .withColumn("i", F.col("_m.i").cast("bigint"))
        .withColumn("role", F.col("_m.role"))
        .withColumn("text", F.col("_m.text"))
        .drop("_m")
    )
    return shifted.unionByName(lead)


def seed_examples(
    indexed: DataFrame, examples: list[tuple[str, str]], picture: bool = False, where: Column | None = None
) -> DataFrame:
    """Put fixed example exchanges before each conversation's own turns.

    ``picture`` marks the first example message with ``<image>``; ``where`` limits the seeding
    to some conversations.
    """
    flat = [t for pair in examples for t in pair]
    if not flat:
        return indexed
    if picture:
        flat[0] = f"{X.IMAGE_TOKEN}\n{flat[0]}"
    chosen = F.lit(True) if where is None else where
    own = indexed.withColumn("i", F.col("i") + F.when(chosen, len(flat)).otherwise(0))
    lead = indexed.filter((F.col("i") == 0) & chosen).withColumn(
        "_m", F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(t).alias("t")) for k, t in enumerate(flat)]))
    )
    lead = (
        lead.withColumn("i", F.col("_m.i").cast("bigint"))
        .withColumn("role", F.when(F.col("_m.i") % 2 == 0, "human").otherwise("gpt"))
        .withColumn("text", F.col("_m.t"))
        .drop("_m")
    )
    return own.unionByName(lead)


def preset_turns(indexed: DataFrame) -> DataFrame:
    """The example exchange that some templates begin with; needs the template columns."""
    return seed_examples(indexed, [tuple(P.EXAMPLE_TURNS)], where=F.col("has_examples"))


def append_system(df: DataFrame, extra: str) -> DataFrame:
    """Add a line to the template's system text."""
    return df.withColumn("system", F.concat("system", F.lit("\n" + extra)))


def opening_of_answer() -> Column:
    """What a prompt ends with when the answer is still to come."""
    return (
        F.when(F.col("style").isin("SINGLE", "TWO"), F.concat("role1", F.lit(":")))
        .when(F.col("style") == "MPT", F.col("role1"))
        .otherwise(F.lit(""))
    )


def prompt_text(body: Column) -> Column:
    """The system text and the joined pieces as one prompt, by the template columns."""
    head = (
        F.when(F.col("style").isin("SINGLE", "TWO", "MPT"), F.concat("system", "sep"))
        .when(F.col("style") == "PLAIN", F.col("system"))
        .otherwise(F.lit(""))
    )
    bare = F.when(F.length("sep") > 0, F.ltrim(body, F.col("sep"))).otherwise(body)
    return F.when(F.col("style") == "LLAMA_2", bare).otherwise(F.concat(head, body))


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *values) for name, values in P.TEMPLATES.items()]
    return spark.createDataFrame(
        rows,
        "template string, system string, role0 string, role1 string, style string, sep string, "
        "sep2 string, version string, has_examples boolean",
    )


def with_template(df: DataFrame, name: str) -> DataFrame:
    """One template for all rows, as constants."""
    for field, value in zip(P.TEMPLATE_FIELDS, P.TEMPLATES[name]):
        df = df.withColumn(field, F.lit(value))
    return df


def join_template(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates by the ``template`` column; rows that name an unknown one are rejects."""
    table = template_table(df.sparkSession)
    return df.join(table, "template"), df.join(table, "template", "left_anti")


def turn_piece() -> Column:
    """What one turn adds to the prompt, from ``i, role, text`` and the template columns."""
    i, text = F.col("i"), F.col("text")
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    even = i % 2 == 0
    role = F.when(F.col("role") == "human", F.col("role0")).otherwise(F.col("role1"))
    alternating = F.when(even, F.col("sep")).otherwise(F.coalesce("sep2", F.lit("")))
    labelled = lambda end: F.when(empty, F.concat(role, F.lit(":"))).otherwise(
        F.concat(role, F.lit(": "), text, end)
    )
    opening = F.when(
        (i == 0) & (F.length("system") > 0),
        F.concat(F.lit("<<SYS>>\n"), F.col("system"), F.lit("\n<</SYS>>\n\n"), text),
    ).otherwise(text)
    bracketed = (
        F.when(empty, F.lit(""))
        .when(even, F.concat(F.col("sep"), F.lit("[INST] "), opening, F.lit(" [/INST]")))
        .otherwise(F.concat(F.lit(" "), text, F.lit(" "), F.col("sep2")))
    )
    return (
        F.when(F.col("style") == "SINGLE", labelled(F.col("sep")))
        .when(F.col("style") == "TWO", labelled(alternating))
        .when(F.col("style") == "MPT", F.when(empty, role).otherwise(F.concat(role, text, F.col("sep"))))
        .when(F.col("style") == "LLAMA_2", bracketed)
        .when(F.col("style") == "PLAIN", F.when(empty, F.lit("")).otherwise(F.concat(text, alternating)))
    )


def render_turns(indexed: DataFrame) -> DataFrame:
    """One row per turn with its ``piece``: the form to keep when a conversation has no bound."""
    return indexed.withColumn("piece", turn_piece())


def render_prompts(indexed: DataFrame) -> DataFrame:
    """``(conv_id, prompt, n_turns)``: pieces joined in order behind the system text.

    ``indexed`` carries the template columns. The grouping holds one conversation's text,
    which is the output cell itself.
    """
    spec = [F.first(c).alias(c) for c in ("system", "style", "sep")]
    folded = render_turns(indexed).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("_p"), *spec
    )
    body = F.array_join(F.col("_p.piece"), "")
    return folded.select("conv_id", prompt_text(body).alias("prompt"), F.size("_p").cast("bigint").alias("n_turns"))


def signal_pieces(indexed: DataFrame, template: str = P.DEFAULT_TEMPLATE) -> DataFrame:
    """``### Role: text`` lines for the default training format; unknown roles stay visible."""
    role0, role1 = P.TEMPLATES[template][1], P.TEMPLATES[template][2]
    speaker = (
        F.when(F.lower("role") == "human", role0).when(F.lower("role") == "gpt", role1).otherwise("unknown")
    )
    return indexed.withColumn("piece", F.concat(F.lit("### "), speaker, F.lit(": "), F.col("text"), F.lit("\n")))


def signal_prompts(indexed: DataFrame, template: str = P.DEFAULT_TEMPLATE) -> DataFrame:
    """``(conv_id, header, pieces, roles, prompt)``; ``pieces`` feed the label mask."""
    header = P.TEMPLATES[template][0] + "\n\n"
    folded = signal_pieces(indexed, template).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "piece", "role"))).alias("_p")
    )
    return folded.select(
        "conv_id",
        F.lit(header).alias("header"),
        F.col("_p.piece").alias("pieces"),
        F.col("_p.role").alias("roles"),
        F.concat(F.lit(header), F.array_join(F.col("_p.piece"), ""), F.lit("### ")).alias("prompt"),
    )


def conversation_lengths(turns: DataFrame, image_tokens: int = 128) -> DataFrame:
    """Words per conversation (+ image tokens) and the signed length used to batch by modality."""
    has_image = F.max(F.contains("text", F.lit(X.IMAGE_TOKEN)))
    return (
        turns.groupBy("conv_id")
        .agg(F.sum(X.word_count("text")).alias("n_words"), has_image.alias("has_image"))
        .withColumn("length", F.col("n_words") + F.when(F.col("has_image"), image_tokens).otherwise(0))
        .withColumn("modality_length", F.when(F.col("has_image"), F.col("n_words")).otherwise(-F.col("n_words")))
    )
