"""The registered queries of this package, one an operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimpse.llm import ann, decontaminate, jaccard, langid, lm, merkle, mixing, passages, quality, sharding, tokens, toxicity, variants


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    c = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_mixing(spark, sf_dir):
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard(spark, sf_dir):
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return passages.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op5_language(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_token_shards(spark, sf_dir):
    m = tokens.materialise(_table(spark, sf_dir, "documents"))
    return m.select("slot", "shard", "offset", "sequence", F.sha2("tokens", 256).alias("sha256"))


def op7_lm_scoring(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ann(spark, sf_dir):
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op11_hilbert_shards(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    """Every row whose id's crc32 three divides is looked at as if its text had been lower-cased."""
    lowered = F.translate("text", variants.UPPER, variants.LOWER)
    return merkle.verify(_table(spark, sf_dir, "documents"), F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text")))


def op13_spelling_variants(spark, sf_dir):
    return variants.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_jaccard, op4_line_dedup, op5_language, op6_token_shards, op7_lm_scoring, op8_quality, op9_toxicity, op10_ann, op11_hilbert_shards, op12_merkle, op13_spelling_variants)}

_WORDS1 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS3 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: crc32 in SQL: its table by the rule that makes it, and the sum over a text's bytes.
_CRCS = "crct as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n)) as crcs)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x'||h)::bigint), lambda c, b: xor(c // 256, crcs[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


def _shards_sql(n_shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 6) -> str:
    out = f"with {_CRCS}, d as (select row_number() over () as i, doc_id, coalesce(strlen(text), 0) + 16 as size, {_crc("coalesce(text, '')")} as crc, {', '.join(dims)} from documents, crct)"
    for k, c in enumerate(dims):
        out += f", v{k} as (select {c} as v, count(*) as w from d group by 1), b{k} as (select v, case when v is null then 0 else floor(coalesce(sum(w) over (order by v nulls first rows between unbounded preceding and 1 preceding), 0) * {1 << bits} / sum(w) over ())::int end as cell from v{k})"
    x = [f"x{k}" for k in range(len(dims))]
    out += f", s0 as (select i, {', '.join(f'b{k}.cell as x{k}' for k in range(len(dims)))} from d {' '.join(f'join b{k} on b{k}.v is not distinct from d.{c}' for k, c in enumerate(dims))})"
    step = 0
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for c in x:
            new = {"x0": f"case when {c} & {1 << b} <> 0 then xor(x0, {low}) else xor(x0, xor(x0, {c}) & {low}) end"}
            if c != "x0":
                new[c] = f"case when {c} & {1 << b} <> 0 then {c} else xor({c}, xor(x0, {c}) & {low}) end"
            step += 1
            out += f", s{step} as (select i, {', '.join(f'{new.get(y, y)} as {y}' for y in x)} from s{step - 1})"
    for y, c in zip(x, x[1:], strict=False):
        step += 1
        out += f", s{step} as (select i, {', '.join(f'xor({z}, {y}) as {z}' if z == c else z for z in x)} from s{step - 1})"
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, case when {x[-1]} & {1 << b} <> 0 then {(1 << b) - 1} else 0 end)"
    index = " + ".join(f"((xor({c}, f) // {1 << b}) % 2) * {1 << (len(x) * b + len(x) - 1 - k)}" for b in range(bits) for k, c in enumerate(x))
    out += f", f as (select *, {flip} as f from s{step}), h as (select i, {index} as h from f), p as (select doc_id, size, crc, row_number() over (order by h, crc, doc_id nulls first) - 1 as pos, count(*) over () as n from d join h using (i))"
    return out + f" select doc_id, size, crc as text_crc32, 'rows' as law, ((pos * {n_shards}) // n)::int as shard, pos - ((pos * {n_shards}) // n * n + {n_shards - 1}) // {n_shards} as slot, null::int as grown_shard from p"


def _levels_sql(p: str, depth: int) -> str:
    """The nodes of each level over ``{p}0`` (g, pos, n, node), ``{p}r``: runs by level, ``{p}t``: each group's top."""
    out = ""
    for j in range(depth):
        out += f", {p}r{j} as (select g, pos // 8 as pos, any_value(n) as n, list(node order by pos) as c from {p}{j} where n > 1 group by g, pos // 8), {p}{j + 1} as (select g, pos, (n + 7) // 8 as n, sha256(array_to_string(c, '')) as node from {p}r{j})"
    return out + f", {p}t as (" + " union all ".join(f"select g, node from {p}{j} where n = 1" for j in range(depth + 1)) + ")"


def _way_sql(p: str, source: str, at: str, group: str, depth: int, more: str) -> str:
    """``{p}w{depth}``: rows of ``source`` with what they fold to (f) and their siblings (proof), level by level."""
    out = f", {p}w0 as (select * from {source})"
    for j in range(depth):
        left, right = (f"array_to_string(r.c[{x}], '')" for x in (f"1:(w.{at} // {8**j}) % 8", f"(w.{at} // {8**j}) % 8 + 2:"))
        out += f", {p}w{j + 1} as (select {more}, case when r.c is null then f else sha256({left} || f || {right}) end as f, case when r.c is null then proof else proof || {left} || {right} end as proof from {p}w{j} w left join {p}r{j} r on r.g is not distinct from w.{group} and r.pos = w.{at} // {8 ** (j + 1)})"
    return out


def _merkle_sql(depth: int = 6, above: int = 3) -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join([*(part(c) for c in ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    low = f"case when {_crc('doc_id::varchar')} % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end"
    return f"""
with {_CRCS}, a as (select doc_id, lang as g, {row('text')} as node, {low} as low, source, lang, n_chars from documents, crct),
b as (select doc_id, g, node, {row('low')} as f, row_number() over (partition by g order by doc_id nulls first, node) - 1 as pos, count(*) over (partition by g) as n from a),
l0 as (select g, pos, n, node from b){_levels_sql("l", depth)},
t0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, node, g as lang from lt){_levels_sql("t", above)},
e as (select b.doc_id, b.g, b.pos, b.node, b.f, '' as proof, t0.pos as tpos, t0.node as subroot, 0 as zero from b join t0 on t0.lang is not distinct from b.g)
{_way_sql("l", "e", "pos", "g", depth, "w.doc_id, w.g, w.pos, w.node, w.tpos, w.subroot, w.zero")}
{_way_sql("t", f"lw{depth}", "tpos", "zero", above, "w.doc_id, w.node, w.tpos, w.subroot, w.zero")}
select doc_id, w.node as leaf, subroot, tt.node as root, sha256(proof) as proof_sha256, f as folded_root, f = tt.node as verified from tw{above} w, tt"""


ORACLES = {
    "op11_hilbert_shards": _shards_sql(),
    "op12_merkle": _merkle_sql(),
    "op13_spelling_variants": rf"""
with recursive {_CRCS}, o as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
r as (select doc_id, run, count(*) as c from o group by all), h as (select run, c, {_crc("coalesce(doc_id::varchar, '') || ':' || run")} as h from r, crct),
m as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from h),
w as (select word, sum(c)::bigint as n from m where length(word) >= 7 group by 1 having sum(c) >= 2),
v as (select word, i, left(word, i::int) || substr(word, i::int + 2) as rest from (select word, unnest(range(length(word))) as i from w)),
p as (select a.word as a, b.word as b from v a join v b on a.rest = b.rest and a.i = b.i and a.word <> b.word union select v.word, w.word from v join w on v.rest = w.word union select w.word, v.word from v join w on v.rest = w.word),
k as (select a, b, x.n, row_number() over (partition by a order by x.n desc, b) as r, count(*) over (partition by a) as n_near from p join w x on x.word = b),
f as (select w.word, w.n, coalesce(k.n_near, 0) as n_near, case when k.n >= 10 * w.n then k.b end as form, case when k.n >= 10 * w.n then k.n end as form_n from w left join k on k.a = w.word and k.r = 1),
c as (select word, form as at_ from f where form is not null union all select c.word, f.form from c join f on f.word = c.at_ where f.form is not null),
e as (select c.word, c.at_ as root from c join f on f.word = c.at_ where f.form is null)
select f.word, form, coalesce(e.root, f.word) as root, n, n_near, form_n from f left join e on e.word = f.word""",
    "op1_decontamination": f"""
with d as (select doc_id, {_WORDS1} as w from documents),
b as (select item_id, {_WORDS1} as w from benchmark where item_id is not null),
win as (select distinct item_id, least(len(w), 13) as k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as g
        from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)),
lens as (select distinct k from win),
dw as (select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lens where len(w) >= k)),
m as (select doc_id, item_id, dw.k, i from dw join win on dw.g = win.g and dw.k = win.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)""",
    "op3_jaccard": f"""
with recursive d as (select doc_id, {_WORDS3} as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
both_ as (select a, b from e union all select b, a from e),
r as (select a as doc_id, a as to_ from both_ union select r.doc_id, both_.b from r join both_ on r.to_ = both_.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, d.doc_id) as component_id
from d left join n using (doc_id) left join (select doc_id, min(to_) as c from r group by doc_id) c using (doc_id)""",
}
