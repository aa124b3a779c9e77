"""The registered queries of this subpackage and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import bytebpe, langid, licenses, linecrf, mixing, neardup, negatives, substrings, suffixes, token_counts, topk, toxicity, turns

#: More tokens than this are over the limit of a context window.
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.calibrate(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("document.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("ratio", 6).alias("ratio"),
        F.round("probability", 6).alias("probability"), "sampled", F.round("sample_weight", 6).alias("sample_weight"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linecrf.judge(docs, linecrf.train(docs, _table(spark, sf_dir, "labels")))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_uniform_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bytebpe.encode(_table(spark, sf_dir, "documents"), path, decoded="decoded")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damage(_table(spark, sf_dir, "conversations"))
    return turns.repair(rows, there=F.col("there"), keep_text=False).drop("repaired")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarize(licenses.scan(_table(spark, sf_dir, "documents")))


def op13_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP4 = f"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
starts as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w),
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as win from starts),
least as (select win, min(doc_id) as first_id from windows group by win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join least using (win) where first_id < doc_id),
cut as (select doc_id, list(p) as ps from gone group by doc_id),
kept as (select doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
    case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end as k from w left join cut using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5 = f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
flat as (select doc_id, len(s) as n, unnest(s) as sh from sets),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
    from flat a join flat b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * c >= 75 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join both_ways e on r.b = e.a),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join comp using (doc_id)
"""

_OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5
"""


def _mixing_sql() -> str:
    """The rounds of raking as a chain of common table expressions."""
    words = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
    lines = r"coalesce(len(regexp_extract_all(text, '\n')), 0) + 1"
    signs = r"coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)"
    sides = ", ".join(mixing.SIDES)
    out = f"""
with d as (select doc_id, source, lang, text, {words} as n_tokens, {lines} as n_lines, {signs} as n_signs from documents),
t as (select *, case when n_tokens < 50 then 'note' when 10 * n_signs > n_tokens then 'markup'
    when n_tokens < 8 * n_lines then 'listing' else 'article' end as topic from d),
cells as (select {sides}, sum(n_tokens)::double as base from t group by {sides}),
total as (select sum(base) as total from cells)"""
    for side in mixing.SIDES:
        power = mixing.EXPONENTS[side]
        out += f""",
own_{side} as (select {side}, sum(base) as own from cells group by {side}),
raw_{side} as (select {side}, case when own > 0 then pow(own / total, {power}) else 0 end as raw from own_{side}, total),
wish_{side} as (select {side}, raw / sum(raw) over () * total as wish_{side} from raw_{side}, total)"""
    wishes = " ".join(f"join wish_{s} on cells.{s} is not distinct from wish_{s}.{s}" for s in mixing.SIDES)
    out += f""",
r0 as (select {", ".join(f"cells.{s}" for s in mixing.SIDES)}, base, base as weight, {", ".join(f"wish_{s}" for s in mixing.SIDES)} from cells {wishes})"""
    at = 0
    for _ in range(mixing.ROUNDS):
        for side in mixing.SIDES:
            out += f""",
r{at + 1} as materialized (select * replace (case when sum(weight) over (partition by {side}) > 0
    then weight / sum(weight) over (partition by {side}) * wish_{side} else 0 end as weight) from r{at})"""
            at += 1
    same = " and ".join(f"t.{s} is not distinct from c.{s}" for s in mixing.SIDES)
    draw = "('0x' || substr(md5(concat_ws('-', coalesce(doc_id::varchar, md5(text), ''), '1')), 1, 12))::bigint::double / 281474976710656.0"
    return out + f""",
c as (select *, case when base > 0 then weight / base else 1 end as ratio from r{at}),
p as (select t.*, ratio, least(1.0, ratio * 0.5) as probability from t join c on {same})
select doc_id, source, lang, topic, n_tokens, round(ratio, 6) as ratio, round(probability, 6) as probability,
    {draw} < probability as sampled, round(case when probability > 0 then ratio / probability else 0 end, 6) as sample_weight from p
"""  # fmt: skip


_NOT_SPACE = r"[^\x20\x09-\x0D]"


def _turns_sql() -> str:
    """Checksum, damage, faults, then the cheapest (cost, audit) of each grammar state, turn by turn, as text of equal width."""

    def plus(state: str, cost: str, edit: str) -> str:
        return f"lpad((substr({state}, 1, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10) || '{edit}'"

    def step(state: int) -> str:
        keeps = {0: [], 1: [("o0", "s")], 2: [(f"o{k}", "u") for k in (0, 1, 3)], 3: [("o2", "a")]}[state]
        ways = [plus(f"o{state}", "4", "D")]
        ways += [f"case when not gone and initial = '{i}' then {plus(s, 'fee', 'K')} end" for s, i in keeps]
        ways += [f"case when not gone and initial <> '{i}' then {plus(s, 'fee + 3', 'R')} end" for s, i in keeps if state > 1]
        return f"least({', '.join(ways)})"

    return f"""
with recursive bits as (select n, list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as entry from range(256) t(n)),
crc as (select list(entry order by n) as entries from bits),
nulls as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
picked as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, entries[((xor(c, b) & 255) + 1)::int])), 4294967295) % 20 as fault from nulls, crc),
harmed as (select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) as copy from picked),
rows as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '-' end as initial from harmed),
faults as (select *, not regexp_matches(text, '{_NOT_SPACE}') as is_blank, row_number() over (partition by conv_id, role, text order by n) > 1 as seen,
    regexp_extract(text, '({_NOT_SPACE})[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as short,
    lag(initial) over (partition by conv_id order by n) || initial as pair from rows),
coded as (select *, is_blank or seen as gone, case when short and not is_blank and not seen then 3 else 0 end as fee from faults),
states as (
    select conv_id, 0::bigint as n, '000000000' as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from conversations group by conv_id
    union all
    select conv_id, n, {", ".join(f"{step(k)} as s{k}" for k in range(4))} from (
        select c.conv_id, c.n, c.initial, c.gone, c.fee, s0 as o0, s1 as o1, least(s2, {plus("s0", "3", "I")}, {plus("s1", "3", "I")}, {plus("s3", "3", "I")}) as o2,
            least(s3, {plus("s0", "6", "II")}, {plus("s1", "6", "II")}, {plus("s2", "3", "I")}) as o3
        from states s join coded c on c.conv_id is not distinct from s.conv_id and c.n = s.n + 1)),
ended as (select conv_id, least(s0, s3, {plus("s2", "3", "I")}, {plus("s1", "6", "II")}) as won from states
    qualify row_number() over (partition by conv_id order by n desc) = 1),
edits as (select conv_id, substr(won, 1, 9)::bigint as cost, substr(won, 10) as audit from ended),
letters as (select conv_id, p, substr(audit, p, 1) as edit from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p from edits)),
placed as (select *, sum((edit <> 'I')::int) over w as n, sum((edit <> 'D')::int) over w as slot from letters window w as (partition by conv_id order by p)),
lines as (select p.conv_id, slot, edit, case edit when 'I' then '' else text end as text, role, max((slot = 1 and edit = 'K' and initial = 's')::int) over (partition by p.conv_id) as led
    from placed p left join coded c on c.conv_id is not distinct from p.conv_id and c.n = p.n where edit <> 'D'),
mended as (select conv_id, string_agg(case when edit = 'K' then role when (slot - led) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by slot) as repaired
    from lines group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (is_blank) as blank,
    count(*) filter (seen and not is_blank) as duplicate, count(*) filter (fee = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from coded group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(repaired, '')) as repaired_sha256
from edits e left join counts c on c.conv_id is not distinct from e.conv_id left join mended m on m.conv_id is not distinct from e.conv_id
"""  # fmt: skip


def _licenses_sql() -> str:
    """Template words as a table, their document frequencies, shifts that all rare words share, key phrases, shares."""
    words, phrases = [], []
    for t, template in enumerate(licenses.TEMPLATES):
        words += [f"({t}, {q}, '{word}')" for q, word in enumerate(template.words)]
        phrases += [f"({t}, {template.position(p)}, {p.split()!r})" for p in template.phrases]
    kinds = ", ".join(f"({t}, '{x.label}', {str(x.base).lower()}, {len(x.words)})" for t, x in enumerate(licenses.TEMPLATES))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (select row_number() over () as row, doc_id, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
kinds(t, label, base, size) as (values {kinds}),
parts(t, q, word) as (values {", ".join(words)}),
phrases(t, q, phrase) as (values {", ".join(phrases)}),
vocabulary as (select distinct word from parts),
spots as (select row, word, i as spot from (select row, unnest(ws) as word, unnest(range(len(ws))) as i from d) join vocabulary using (word)),
held as (select word, count(distinct row) as df from spots group by word),
ranked as (select t, word, min(q) as q, row_number() over (partition by t order by coalesce(any_value(df), 0), word) as rank from parts left join held using (word) group by t, word),
rare as (select t, word, q, count(*) over (partition by t) as need from ranked where rank <= {licenses.RARE}),
shifts as (select row, t, spot - q as start from spots join rare using (word) group by row, t, spot - q having count(distinct word) = any_value(need)),
verified as (select s.row, s.t, s.start from shifts s join phrases p using (t) join d using (row) where s.start >= 0
    group by s.row, s.t, s.start having bool_and(ws[s.start + p.q + 1:s.start + p.q + len(p.phrase)] = p.phrase)),
shares as (select v.row, v.t, v.start, sum((ws[v.start + q + 1] is not distinct from word)::int) / any_value(size)::double as share
    from verified v join d using (row) join parts p on p.t = v.t join kinds k on k.t = v.t group by v.row, v.t, v.start),
found as (select row, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score
    from shares join kinds using (t) group by row)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
    coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score from d left join found using (row)
"""  # fmt: skip


_OP13 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score
    from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 10
"""


_NAMED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_mix_sources, op2_token_counts, op3_language_id, op4_substring_dedup, op5_minhash_near_dedup, op6_line_crf_quality,
    op7_subword_toxicity, op8_uniform_threshold_top_k, op9_suffix_array_dedup, op10_byte_bpe, op11_turn_repair, op12_license_scan,
    op13_bond_hard_negatives, pipeline,
)
QUERIES = {q.__name__: q for q in _NAMED}
ORACLES = {
    "op1_mix_sources": _mixing_sql(), "op4_substring_dedup": _OP4, "op5_minhash_near_dedup": _OP5, "op8_uniform_threshold_top_k": _OP8,
    "op11_turn_repair": _turns_sql(), "op12_license_scan": _licenses_sql(), "op13_bond_hard_negatives": _OP13,
}
