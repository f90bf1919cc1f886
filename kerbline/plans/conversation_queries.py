"""Conversations: checks, prompts, token ids, label masks, batches."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import prompt_texts as PT
from ..functions import text as X
from ..operators import batches as B
from ..operators import conversations as C
from ..operators import tokens as K
from ..scale import spread
from . import fixtures as D
from .registry import ORACLES, query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FACTS = """facts AS (SELECT conv_id, min(turn) AS t_min, max(turn) AS t_max, count(*) AS n, count(DISTINCT turn) AS nd, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id),
f0 AS (SELECT *, t_min + CASE WHEN first_role = 'user' THEN 0 ELSE 1 END AS t0 FROM facts),
idx0 AS (SELECT c.conv_id, c.turn, c.turn - t0 AS i, CASE c.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE c.role END AS role, text
         FROM conversations c JOIN f0 USING (conv_id) WHERE c.turn >= t0),
wrong AS (SELECT DISTINCT conv_id FROM idx0 WHERE role <> CASE WHEN i % 2 = 0 THEN 'human' ELSE 'gpt' END),
rejects AS (SELECT conv_id, CASE WHEN t_max - t_min + 1 <> n OR nd <> n THEN 'gap in turns' WHEN t0 > t_max THEN 'no human turn'
            WHEN conv_id IN (SELECT conv_id FROM wrong) THEN 'roles do not alternate' END AS reason FROM f0),
idx AS (SELECT * FROM idx0 WHERE conv_id NOT IN (SELECT conv_id FROM rejects WHERE reason IS NOT NULL))"""


def _indexed(spark, sf):
    return C.index_turns(C.normalise_roles(D.turns(spark, sf)))[0]


def _piece_sql(template: str, text: str = "text") -> str:
    system, role0, role1, style, sep, sep2, _, _ = PT.TEMPLATES[template]
    role = f"CASE WHEN role = 'human' THEN {q(role0)} ELSE {q(role1)} END"
    alt = f"CASE WHEN i % 2 = 0 THEN {q(sep)} ELSE {q(sep2 or '')} END"
    if style in ("SINGLE", "TWO"):
        end = q(sep) if style == "SINGLE" else alt
        return f"CASE WHEN {text} = '' THEN {role} || ':' ELSE {role} || ': ' || {text} || {end} END"
    if style == "MPT":
        return f"{role} || {text} || {q(sep)}"
    if style == "LLAMA_2":
        opening = f"CASE WHEN i = 0 THEN {q(f'<<SYS>>{chr(10)}{system}{chr(10)}<</SYS>>{chr(10)}{chr(10)}') if system else q('')} ELSE '' END"
        return f"CASE WHEN i % 2 = 0 THEN {q(sep)} || '[INST] ' || {opening} || {text} || ' [/INST]' ELSE ' ' || {text} || ' ' || {q(sep2)} END"
    return f"{text} || {alt}"


def _prompt_sql(template: str, source: str = "idx", text: str = "text", extra: str = "") -> str:
    """``conv_id, prompt, n_turns`` of one template."""
    system, _, _, style, sep, _, _, _ = PT.TEMPLATES[template]
    system += extra
    body = f"string_agg({_piece_sql(template, text)}, '' ORDER BY i)"
    if style in ("SINGLE", "TWO", "MPT"):
        prompt = f"{q(system + sep)} || {body}"
    elif style == "LLAMA_2":
        prompt = f"substr({body}, {len(sep) + 1})"
    else:
        prompt = f"{q(system)} || {body}"
    return f"SELECT conv_id, {prompt} AS prompt, count(*) AS n_turns FROM {source} GROUP BY conv_id"


def _prompts(spark, sf, template):
    return C.render_prompts(C.with_template(_indexed(spark, sf), template))


@query("conversation_rejects", f"WITH {_FACTS} SELECT conv_id, reason FROM rejects WHERE reason IS NOT NULL")
def conversation_rejects(spark, sf):
    return C.index_turns(C.normalise_roles(D.turns(spark, sf)))[1]


_BROKEN = _FACTS.replace("FROM conversations", "FROM broken")


@query(
    "conversation_rejects_broken",
    f"""WITH broken AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 3 AND turn = 3 THEN 'user' ELSE role END AS role, text FROM conversations
        WHERE NOT (conv_id % 7 = 5 AND turn = 1) AND NOT (conv_id % 7 = 6 AND role = 'user')), {_BROKEN}
    SELECT conv_id, reason FROM rejects WHERE reason IS NOT NULL""",
)
def conversation_rejects_broken(spark, sf):
    """Wrong roles, gaps and missing human turns."""
    broken = D.turns(spark, sf).withColumn(
        "role", F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 3), "user").otherwise(F.col("role"))
    )
    broken = broken.filter("not (conv_id % 7 = 5 and turn = 1)").filter(
        ~((F.col("conv_id") % 7 == 6) & (F.col("role") == "user"))
    )
    return C.index_turns(C.normalise_roles(broken))[1]


_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


@query(
    "conversation_prompts",
    f"""WITH {_FACTS}, p AS ({_prompt_sql("vicuna_v1")}),
    l AS (SELECT conv_id, sum({_WORDS.format("text")})::BIGINT AS length FROM conversations GROUP BY conv_id)
    SELECT conv_id, prompt, n_turns, length FROM p JOIN l USING (conv_id)""",
)
def conversation_prompts(spark, sf):
    """The rendered prompt and the length of each conversation."""
    lengths = C.conversation_lengths(D.turns(spark, sf)).select("conv_id", "length")
    return _prompts(spark, sf, "vicuna_v1").join(lengths, "conv_id")


for _name, _template in (
    ("prompts_single_separator", "vision_v0"),
    ("prompts_turn_marks", "mpt"),
    ("prompts_bracketed", "llama_2"),
    ("prompts_bracketed_bare", "mistral_instruct"),
    ("prompts_plain", "plain"),
):
    query(_name, f"WITH {_FACTS} {_prompt_sql(_template)}")(
        lambda spark, sf, t=_template: _prompts(spark, sf, t)
    )


@query(
    "prompt_turn_pieces",
    f"WITH {_FACTS} SELECT conv_id, i, {_piece_sql('vicuna_v1')} AS piece FROM idx",
)
def prompt_turn_pieces(spark, sf):
    return C.render_turns(C.with_template(_indexed(spark, sf), "vicuna_v1")).select("conv_id", "i", "piece")


@query(
    "conversation_lengths",
    f"""WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN '<image> ' || text ELSE text END AS text FROM conversations),
    w AS (SELECT conv_id, sum({_WORDS.format("text")})::BIGINT AS n_words, bool_or(contains(text, '<image>')) AS has_image FROM c GROUP BY conv_id)
    SELECT *, n_words + CASE WHEN has_image THEN 128 ELSE 0 END AS length, CASE WHEN has_image THEN n_words ELSE -n_words END AS modality_length FROM w""",
)
def conversation_lengths(spark, sf):
    return C.conversation_lengths(_with_images(D.turns(spark, sf)))


def _with_images(turns):
    """Every third conversation opens with a picture."""
    opening = (F.col("conv_id") % 3 == 0) & (F.col("turn") == 0)
    return turns.withColumn("text", F.when(opening, F.concat(F.lit("<image> "), "text")).otherwise(F.col("text")))


_MODELS = [
    "vision-v1.5-7b", "vision-llama-2-13b", "Vision-Mistral-7b", "vision-mistral-orca", "vision-v1.6-34b",
    "vision-mpt-7b", "vision-v1-mmtag", "vision-plain-7b", "mpt-30b", "llama-2-7b", "other-13b", "vision-mixtral-hermes",
]


def _model_case(values) -> str:
    return "CASE conv_id % " + str(len(_MODELS)) + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


_CHOSEN = [
    "vision_v1", "vision_llama_2", "mistral_instruct", "mistral_orca", "chatml_direct", "mpt", "v1_mmtag", "v0_mmtag",
    "mpt_text", "llama_2", "vicuna_v1", "chatml_direct",
]


@query(
    "prompts_by_model_name",
    f"""WITH {_FACTS}, m AS (SELECT DISTINCT conv_id, {_model_case(_CHOSEN)} AS template FROM idx),
    p AS ({" UNION ALL ".join(f"SELECT conv_id, prompt, {q(t)} AS template FROM ({_prompt_sql(t)})" for t in sorted(set(_CHOSEN) & set(PT.TEMPLATES)))})
    SELECT m.conv_id, m.template, p.prompt FROM m LEFT JOIN p USING (conv_id, template)""",
)
def prompts_by_model_name(spark, sf, marker="vision"):
    """Template per model name; names of templates that do not exist leave no prompt."""
    models = [re.sub("(?i)vision", marker, m) for m in _MODELS]
    named = F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("conv_id") % len(models)).cast("int") + 1)
    idx = _indexed(spark, sf).withColumn("template", X.template_for_model(named, marker))
    good, rejects = C.join_template(idx)
    prompts = C.render_prompts(good).join(good.select("conv_id", "template").distinct(), "conv_id")
    missing = rejects.select("conv_id", "template").distinct().withColumn("prompt", F.lit(None).cast("string"))
    return prompts.select("conv_id", "template", "prompt").unionByName(missing)


@query("prompts_by_other_marker", ORACLES["prompts_by_model_name"])
def prompts_by_other_marker(spark, sf):
    """Another family's marker in the model names chooses the same templates."""
    return prompts_by_model_name(spark, sf, "seer")


@query(
    "prompts_with_picture",
    f"""WITH {_FACTS}, im AS (SELECT conv_id, i, role, CASE WHEN i = 0 AND conv_id % 3 = 0 THEN '<image>' || chr(10) || trim(text, ' {chr(9)}{chr(10)}{chr(13)}') ELSE text END AS text FROM idx)
    {_prompt_sql("vision_v1", "im")}""",
)
def prompts_with_picture(spark, sf):
    placed = C.place_image(_indexed(spark, sf), F.col("conv_id") % 3 == 0)
    return C.render_prompts(C.with_template(placed, "vision_v1"))


@query(
    "prompts_with_tagged_picture",
    f"""WITH {_FACTS}, im AS (
      SELECT conv_id, i + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS i, role, CASE WHEN i = 0 AND conv_id % 3 = 0 THEN trim(text, ' {chr(9)}{chr(10)}{chr(13)}') ELSE text END AS text FROM idx
      UNION ALL SELECT conv_id, 0, 'human', '<Image><image></Image>' FROM idx WHERE i = 0 AND conv_id % 3 = 0
      UNION ALL SELECT conv_id, 1, 'gpt', 'Received.' FROM idx WHERE i = 0 AND conv_id % 3 = 0)
    {_prompt_sql("v1_mmtag", "im")}""",
)
def prompts_with_tagged_picture(spark, sf):
    placed = C.place_image(_indexed(spark, sf), F.col("conv_id") % 3 == 0, tagged=True)
    return C.render_prompts(C.with_template(placed, "v1_mmtag"))


_EXAMPLES = [("Where is the door?", "Ahead on the left."), ("Is the path clear?", "Yes, follow the path.")]


@query(
    "prompts_with_examples",
    f"""WITH {_FACTS}, ex AS (SELECT conv_id, i + 4 AS i, role, text FROM idx
      UNION ALL SELECT conv_id, k, CASE WHEN k % 2 = 0 THEN 'human' ELSE 'gpt' END, t FROM idx, (VALUES (0, {q('<image>' + chr(10) + _EXAMPLES[0][0])}), (1, {q(_EXAMPLES[0][1])}), (2, {q(_EXAMPLES[1][0])}), (3, {q(_EXAMPLES[1][1])})) e(k, t) WHERE i = 0)
    {_prompt_sql("vision_v0", "ex", extra=chr(10) + "Be brief.")}""",
)
def prompts_with_examples(spark, sf):
    """Few-shot prompts: a longer system text, two examples, the first with a picture."""
    seeded = C.seed_examples(_indexed(spark, sf), _EXAMPLES, picture=True)
    return C.render_prompts(C.append_system(C.with_template(seeded, "vision_v0"), "Be brief."))


@query(
    "prompts_with_preset_turns",
    f"""WITH {_FACTS}, ex AS (SELECT conv_id, i + 2 AS i, role, text FROM idx
      UNION ALL SELECT conv_id, k, CASE WHEN k = 0 THEN 'human' ELSE 'gpt' END, t FROM idx, (VALUES (0, {q(PT.EXAMPLE_TURNS[0])}), (1, {q(PT.EXAMPLE_TURNS[1])})) e(k, t) WHERE i = 0)
    {_prompt_sql("v0", "ex")}""",
)
def prompts_with_preset_turns(spark, sf):
    """A template that begins with its own example exchange."""
    return C.render_prompts(C.preset_turns(C.with_template(_indexed(spark, sf), "v0")))


@query(
    "prompts_signalled",
    f"""WITH {_FACTS} SELECT conv_id, {q(PT.TEMPLATES["vicuna_v1"][0] + chr(10) + chr(10))} || string_agg('### ' || CASE role WHEN 'human' THEN 'USER' WHEN 'gpt' THEN 'ASSISTANT' ELSE 'unknown' END || ': ' || text || chr(10), '' ORDER BY i) || '### ' AS prompt
    FROM idx GROUP BY conv_id""",
)
def prompts_signalled(spark, sf):
    return C.signal_prompts(_indexed(spark, sf)).select("conv_id", "prompt")


_WS = " \t\n\r"


@query(
    "image_tokens_moved",
    f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 20) || '<image>' || substr(text, 21) ELSE text END AS text FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(text, '<image>')
       THEN replace(trim('<image>' || chr(10) || trim(replace(text, '<image>', ''), '{_WS}'), '{_WS}'), '<image>', '<im_start><image><im_end>') ELSE text END AS text FROM c""",
)
def image_tokens_moved(spark, sf):
    c = D.turns(spark, sf).withColumn(
        "text",
        F.when(F.col("turn") % 2 == 0, F.concat(F.substring("text", 1, 20), F.lit("<image>"), F.expr("substring(text, 21)"))).otherwise(F.col("text")),
    )
    return c.select("conv_id", "turn", C.move_image_token("text", start_end=("<im_start>", "<im_end>")).alias("text"))


# ---- token ids and labels ---------------------------------------------------------------

TOK = K.WordTokenizer()
_SPECIAL = "(</s>|<s>|<\\|im_start\\|>|<\\|im_end\\|>|###)"


def _ids_sql(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace({text}, '{_SPECIAL}', ' \\1 ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT + 10)"


def _joined(col: str):
    return F.array_join(F.transform(col, lambda t: t.cast("string")), " ")


@query(
    "token_ids_truncated",
    f"""WITH t AS (SELECT conv_id, turn, list_prepend(1, {_ids_sql("text")}) AS ids FROM conversations)
    SELECT conv_id, turn, array_to_string(ids[1:24], ' ') AS ids, len(ids[1:24]) AS n FROM t""",
)
def token_ids_truncated(spark, sf):
    tok = K.WordTokenizer(model_max_length=24)
    out = K.plain_ids(D.turns(spark, sf), "text", tok, "ids")
    return out.select("conv_id", "turn", _joined("ids").alias("ids"), F.col("ids_len").alias("n"))


@query(
    "token_ids_with_pictures",
    f"""WITH c AS (SELECT doc_id, replace(text, '.', '<image>') AS text FROM documents),
    p AS (SELECT doc_id, unnest(string_split(text, '<image>')) AS part, generate_subscripts(string_split(text, '<image>'), 1) AS k FROM c),
    s AS (SELECT doc_id, sum(len({_ids_sql("part")}))::BIGINT AS n_words, max(k) - 1 AS n_images, sum(list_sum({_ids_sql("part")}))::BIGINT AS id_sum FROM p GROUP BY doc_id)
    SELECT doc_id, 1 + n_words + n_images AS n, n_images, coalesce(id_sum, 0) + 1 - 200*n_images AS id_sum FROM s""",
)
def token_ids_with_pictures(spark, sf):
    """Every full stop of a document becomes an image place."""
    docs = spread(D.table(spark, sf, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", X.swap("text", ".", "<image>").alias("text"))
    ids = K.image_token_ids(docs, "text", TOK, "ids")
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, t: a + t)
    return ids.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n"),
        F.size(F.filter("ids", lambda t: t == K.IMAGE_ID)).cast("bigint").alias("n_images"),
        total.alias("id_sum"),
    )


def _label_sql(prompts: str, rounds: str, sep: str, lead: int, trim: int, later: int = 0) -> str:
    """Labels by position ranges: round r keeps the ids behind its instruction."""
    return f"""WITH {_FACTS}, p AS ({prompts}),
    t AS (SELECT conv_id, prompt, list_prepend(1, {_ids_sql("prompt")}) AS ids, {rounds} AS rounds FROM p),
    r AS (SELECT conv_id, unnest(rounds) AS round, generate_subscripts(rounds, 1) AS k FROM t),
    g AS (SELECT *, string_split(round, {q(sep)}) AS parts FROM r),
    ok AS (SELECT *, min(CASE WHEN round = '' OR len(parts) <> 2 THEN k END) OVER (PARTITION BY conv_id) AS stop FROM g),
    l AS (SELECT conv_id, k, 1 + len({_ids_sql("round")}) + CASE WHEN k > 1 THEN {later} ELSE 0 END AS rl,
            greatest(0, 1 + len({_ids_sql("parts[1] || " + q(sep))}) - {trim} + CASE WHEN k > 1 THEN {later} ELSE 0 END) AS il FROM ok WHERE stop IS NULL OR k < stop),
    s AS (SELECT *, {lead} + coalesce(sum(rl) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l),
    c AS (SELECT t.conv_id, len(ids) AS n, {lead} + coalesce((SELECT sum(rl) FROM l WHERE l.conv_id = t.conv_id), 0) AS cur FROM t),
    e AS (SELECT conv_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM t),
    kept AS (SELECT e.conv_id, count(*) AS n_kept, sum(id)::BIGINT AS id_sum FROM e JOIN s ON s.conv_id = e.conv_id AND pos >= st + il AND pos < st + rl GROUP BY 1)
    SELECT c.conv_id, n AS n_ids, cur <> n AS mismatch, CASE WHEN cur <> n THEN 0 ELSE coalesce(n_kept, 0) END AS n_kept,
           CASE WHEN cur <> n THEN 0 ELSE coalesce(id_sum, 0) END AS id_sum FROM c LEFT JOIN kept USING (conv_id)"""


def _label_facts(rows):
    kept = F.filter("labels", lambda t: t != K.IGNORE)
    return rows.select(
        "conv_id",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        "mismatch",
        F.size(kept).cast("bigint").alias("n_kept"),
        F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"),
    )


_LONG = K.WordTokenizer(model_max_length=1_000_000)


@query("labels_two_separators", _label_sql(_prompt_sql("vision_v1"), "string_split(prompt, '</s>')", " ASSISTANT: ", 1, 2))
def labels_two_separators(spark, sf):
    return _label_facts(K.label_by_style(_prompts(spark, sf, "vision_v1"), _LONG, "vision_v1"))


@query("labels_bracketed", _label_sql(_prompt_sql("vision_llama_2"), "string_split(prompt, '</s>')", "[/INST] ", 1, 2))
def labels_bracketed(spark, sf):
    return _label_facts(K.label_by_style(_prompts(spark, sf, "vision_llama_2"), _LONG, "vision_llama_2"))


_CUT = "string_split(prompt, '<|im_end|>')"


@query(
    "labels_turn_marks",
    _label_sql(
        _prompt_sql("mpt"),
        f"[array_to_string({_CUT}[1:3], '<|im_end|>')] || list_transform(range(4, len({_CUT}) + 1, 2), lambda k: array_to_string({_CUT}[k:k+1], '<|im_end|>'))",
        "<|im_end|><|im_start|>assistant\n", 0, 1, 1,
    ),
)
def labels_turn_marks(spark, sf):
    return _label_facts(K.label_by_style(_prompts(spark, sf, "mpt"), _LONG, "mpt"))


@query(
    "labels_plain",
    f"""WITH {D.PAIRS}, t AS (SELECT pair_id AS conv_id, {_ids_sql("pred || chr(10)")} AS ids FROM pairs)
    SELECT conv_id, 2 + len(ids) AS n_ids, len(ids) AS n_kept, list_sum(ids)::BIGINT AS id_sum FROM t""",
)
def labels_plain(spark, sf):
    p = D.pairs(spark, sf).select(
        F.col("pair_id").alias("conv_id"), F.array(F.concat(F.lit("<image>"), "truth"), F.col("pred")).alias("texts")
    )
    rows = K.label_by_style(p, TOK, "plain").withColumn("mismatch", F.lit(False))
    return _label_facts(rows).drop("mismatch")


@query(
    "labels_signalled",
    f"""WITH {_FACTS}, pc AS (SELECT conv_id, i, role, '### ' || CASE role WHEN 'human' THEN 'USER' ELSE 'ASSISTANT' END || ': ' || text || chr(10) AS piece FROM idx),
    hd AS (SELECT {q(PT.TEMPLATES["vicuna_v1"][0] + chr(10) + chr(10))} AS header),
    pr AS (SELECT conv_id, list_prepend(1, {_ids_sql("any_value(header) || string_agg(piece, '' ORDER BY i) || '### '")}) AS ids FROM pc, hd GROUP BY conv_id),
    ln AS (SELECT conv_id, i, role, 1 + len({_ids_sql("piece")}) AS n, 1 + len({_ids_sql("header")}) AS h FROM pc, hd),
    st AS (SELECT *, h + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ln),
    e AS (SELECT conv_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM pr),
    m AS (SELECT e.* FROM e JOIN (SELECT DISTINCT conv_id, h FROM ln) x USING (conv_id) WHERE pos >= h
          AND NOT EXISTS (SELECT 1 FROM st WHERE st.conv_id = e.conv_id AND st.role = 'human' AND pos >= s + 2 AND pos < s + n))
    SELECT pr.conv_id, len(any_value(ids)) AS n_ids, count(m.id) AS n_kept, coalesce(sum(m.id), 0)::BIGINT AS id_sum FROM pr LEFT JOIN m USING (conv_id) GROUP BY pr.conv_id""",
)
def labels_signalled(spark, sf):
    rows = K.label_by_style(C.signal_prompts(_indexed(spark, sf)), _LONG, "vision_v0")
    return _label_facts(rows.withColumn("mismatch", F.lit(False))).drop("mismatch")


# ---- batches ----------------------------------------------------------------------------

def _lengths(spark, sf):
    return C.conversation_lengths(_with_images(D.turns(spark, sf))).select("conv_id", "length", "modality_length")


_LEN = f"""c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN '<image> ' || text ELSE text END AS text FROM conversations),
w AS (SELECT conv_id, sum({_WORDS.format("text")})::BIGINT AS n, bool_or(contains(text, '<image>')) AS im FROM c GROUP BY conv_id),
lens AS (SELECT conv_id, n + CASE WHEN im THEN 128 ELSE 0 END AS length, CASE WHEN im THEN n ELSE -n END AS modality_length FROM w)"""


@query(
    "batches_by_length",
    f"""WITH {_LEN}, s AS (SELECT *, row_number() OVER (ORDER BY md5('17|' || conv_id), conv_id) - 1 AS pos FROM lens)
    SELECT conv_id, length, pos // 8 AS mega, 0 AS rank, row_number() OVER (PARTITION BY pos // 8 ORDER BY length DESC, pos) - 1 AS slot FROM s""",
)
def batches_by_length(spark, sf):
    return B.length_batches(_lengths(spark, sf).drop("modality_length"), "conv_id", "length", 8)


@query(
    "batches_by_length_uneven",
    f"""WITH {_LEN}, s AS (SELECT *, row_number() OVER (ORDER BY md5('17|' || conv_id), conv_id) - 1 AS pos, count(*) OVER () AS cnt FROM lens),
    r AS (SELECT *, pos // 12 AS mega, row_number() OVER (PARTITION BY pos // 12 ORDER BY length DESC, pos) - 1 AS rn, least(12, cnt - pos // 12 * 12) AS size FROM s)
    SELECT mega, count(*) AS n, sum(length)::BIGINT AS total FROM r GROUP BY mega""",
)
def batches_by_length_uneven(spark, sf):
    """Three ranks: every mega-batch keeps its rows whichever rank gets them."""
    dealt = B.length_batches(_lengths(spark, sf).drop("modality_length"), "conv_id", "length", 4, world_size=3)
    return dealt.groupBy("mega").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))


@query(
    "batches_over_ranks",
    f"""WITH RECURSIVE {_LEN}, s AS (SELECT *, row_number() OVER (ORDER BY md5('17|' || conv_id), conv_id) - 1 AS pos, count(*) OVER () AS cnt FROM lens),
    r AS MATERIALIZED (SELECT conv_id, length, pos // 16 AS mega, row_number() OVER (PARTITION BY pos // 16 ORDER BY length DESC, pos) - 1 AS rn, least(16, cnt - pos // 16 * 16) AS n FROM s),
    d AS (SELECT DISTINCT mega, -1::BIGINT AS rn, [0, 0, 0, 0]::DOUBLE[] AS load, [0, 0, 0, 0]::BIGINT[] AS cnt, 0::BIGINT AS k FROM r WHERE n % 4 = 0
      UNION ALL SELECT mega, rn, list_transform(range(1, 5), lambda i: CASE WHEN i <> k THEN load[i] WHEN cnt[i] = n // 4 - 1 THEN 'inf'::DOUBLE ELSE load[i] + length END),
        list_transform(range(1, 5), lambda i: cnt[i] + (i = k)::BIGINT), k
      FROM (SELECT r.mega, r.rn, r.n, r.length, d.load, d.cnt, list_position(d.load, list_min(d.load))::BIGINT AS k FROM d JOIN r ON r.mega = d.mega AND r.rn = d.rn + 1))
    SELECT r.conv_id, r.length, r.mega, coalesce(d.k - 1, r.rn % 4) AS rank, coalesce(d.cnt[d.k] - 1, r.rn // 4) AS slot FROM r LEFT JOIN d ON d.mega = r.mega AND d.rn = r.rn""",
)
def batches_over_ranks(spark, sf):
    """Greedy deal over four ranks; the SQL deals row by row."""
    return B.length_batches(_lengths(spark, sf).drop("modality_length"), "conv_id", "length", 4, world_size=4)


@query(
    "batches_by_modality",
    f"""WITH {_LEN}, m AS (SELECT conv_id, modality_length, CASE WHEN modality_length > 0 THEN 'image' ELSE 'text' END AS modality, abs(modality_length) AS len FROM lens),
    s AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY md5('17|' || conv_id), conv_id) - 1 AS pos, count(*) OVER (PARTITION BY modality) AS cnt FROM m),
    g AS (SELECT *, pos // 8 AS mega, (cnt - 1) // 8 AS last FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY modality, mega ORDER BY len DESC, pos) - 1 AS rn FROM g),
    n AS (SELECT modality, mega, row_number() OVER (ORDER BY md5('17|batch|' || modality || '|' || mega), modality, mega) - 1 AS batch_no FROM (SELECT DISTINCT modality, mega FROM g WHERE mega <> last))
    SELECT conv_id, modality, batch_no, rn AS place FROM o JOIN n USING (modality, mega)
    UNION ALL SELECT conv_id, modality, (SELECT count(*) FROM n), row_number() OVER (ORDER BY conv_id) - 1 FROM g WHERE mega = last""",
)
def batches_by_modality(spark, sf):
    rows = _lengths(spark, sf).drop("length")
    return B.modality_batches(rows, "conv_id", "modality_length", 8).drop("modality_length")


def _batched_ids(spark, sf):
    """Ids of every turn, told apart by conversation and turn."""
    ids = K.plain_ids(_all_turns(spark, sf), "text", K.WordTokenizer(model_max_length=1_000_000))
    return ids.select("turn_id", "batch", "input_ids", F.col("input_ids").alias("labels"))


def _all_turns(spark, sf):
    rows = D.turns(spark, sf).withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    return rows.withColumn("batch", F.col("turn_id") % 13)


_TURN_IDS = "(SELECT conv_id * 1000 + turn AS turn_id, (conv_id * 1000 + turn) % 13 AS batch, text FROM conversations)"
_BATCH_IDS = f"""b AS (SELECT turn_id, batch, list_prepend(1, {_ids_sql("text")}) AS ids FROM {_TURN_IDS}),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS mx FROM b)"""


@query(
    "batches_padded_right",
    f"""WITH {_BATCH_IDS} SELECT turn_id, batch, array_to_string(ids || list_transform(range(mx - len(ids)), lambda i: 0), ' ') AS input_ids,
      array_to_string(ids || list_transform(range(mx - len(ids)), lambda i: -100), ' ') AS labels, len(ids) AS n_real FROM m""",
)
def batches_padded_right(spark, sf):
    out = K.pad_batches(_batched_ids(spark, sf), "batch", pad_id=0)
    return out.select(
        "turn_id", "batch", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"),
        F.size(F.filter("attention_mask", lambda b: b)).cast("bigint").alias("n_real"),
    )


def _spliced_sql(cut: str) -> str:
    return f"""WITH b AS (SELECT turn_id, batch, {_ids_sql("text")} AS w FROM {_TURN_IDS}),
    s AS (SELECT turn_id, batch, ([1] || w[1:2] || list_transform(range(5), lambda i: -200) || w[3:]){cut} AS ids, ([1] || w[1:2] || list_transform(range(5), lambda i: -100) || w[3:]){cut} AS labs FROM b),
    m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS mx FROM s)
    SELECT turn_id, batch, array_to_string(list_transform(range(mx - len(ids)), lambda i: 0) || ids, ' ') AS input_ids,
      array_to_string(list_transform(range(mx - len(ids)), lambda i: -100) || labs, ' ') AS labels,
      array_to_string(list_transform(range(mx - len(ids)), lambda i: 0) || range(len(ids)), ' ') AS position_ids FROM m"""


def _spliced(spark, sf, max_length):
    rows = _all_turns(spark, sf).select("turn_id", "batch", TOK.ids(F.col("text")).alias("w"))
    rows = rows.select(
        "turn_id", "batch",
        F.concat(F.slice("w", 1, 3), F.array(F.lit(K.IMAGE_ID)), F.slice("w", 4, 10_000_000)).alias("input_ids"),
    ).withColumn("labels", F.col("input_ids"))
    out = K.splice_image_places(rows, F.lit(5), max_length=max_length, batch="batch", padding_side="left")
    return out.select(
        "turn_id", "batch", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"),
        _joined("position_ids").alias("position_ids"),
    )


@query("image_places_spliced_left", _spliced_sql(""))
def image_places_spliced_left(spark, sf):
    """One image place behind the second word becomes five; batches are padded on the left."""
    return _spliced(spark, sf, None)


@query("image_places_cut", _spliced_sql("[1:30]"))
def image_places_cut(spark, sf):
    """The same with the cut at the longest row the model takes."""
    return _spliced(spark, sf, 30)


@query(
    "questions_chunked",
    """WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS cnt FROM documents)
    SELECT doc_id, (floor((rn - 1)/ceil(cnt/7.0::DOUBLE)))::BIGINT AS chunk FROM t""",
)
def questions_chunked(spark, sf):
    return B.chunked(D.table(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


@query(
    "questions_one_chunk",
    """WITH t AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS rn, count(*) OVER () AS cnt FROM events)
    SELECT event_id, event_type FROM t WHERE floor((rn - 1)/ceil(cnt/9.0::DOUBLE)) = 4""",
)
def questions_one_chunk(spark, sf):
    """Ordered by a text column with few values first: the cut points split its long runs."""
    return B.get_chunk(D.table(spark, sf, "events").select("event_id", "event_type"), ["event_type", "event_id"], 9, 4)


@query(
    "files_seeded_sample",
    "SELECT doc_id, source FROM documents ORDER BY md5('17|' || doc_id), doc_id LIMIT 50",
)
def files_seeded_sample(spark, sf):
    return B.seeded_sample(D.table(spark, sf, "documents").select("doc_id", "source"), 50, "doc_id")


@query(
    "answers_zipped_by_position",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents),
    b AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS position FROM events)
    SELECT position, doc_id, event_id FROM a JOIN b USING (position)""",
)
def answers_zipped_by_position(spark, sf):
    return B.zip_by_position(
        D.table(spark, sf, "documents").select("doc_id"), ["doc_id"],
        D.table(spark, sf, "events").select("value", "event_id"), ["value", "event_id"],
    ).drop("value")


@query(
    "token_ids_by_encoder",
    """SELECT conv_id, turn, array_to_string([1] || list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w)), ' ') AS ids FROM conversations""",
)
def token_ids_by_encoder(spark, sf):
    """An encoder of the user's own behind the tokenizer interface: the length of each word."""
    tok = K.ArrowTokenizer(lambda: lambda text: [1, *map(len, text.split())], model_max_length=1_000_000)
    ids = K.plain_ids(D.turns(spark, sf), "text", tok, "ids")
    return ids.select("conv_id", "turn", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))
