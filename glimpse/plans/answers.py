"""Queries of refinement, fusion by keywords, questions inside a video, readings of frames and submissions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimpse.functions import querylog as ql
from glimpse.operators import frames as fr
from glimpse.operators import fusion as fu
from glimpse.operators import search as se
from glimpse.operators import session as ss
from glimpse.plans import fixtures as fx
from glimpse.plans.catalog import _KNN, hybrid, hybrid_sql, query
from glimpse.plans.fixtures import ctes
from glimpse.plans.understanding import _LOG, _STAGES, log


def _gray():
    e = F.col("event_id")
    return F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: ((e * 31 + i * i * 7) % 97).cast("double"))


@query(ctes("kf") + ", b as (select event_id, r*8+c as p, (event_id*31 + (r*9+c+1)*(r*9+c+1)*7) % 97 > (event_id*31 + (r*9+c)*(r*9+c)*7) % 97 as b from kf, range(8) x(r), range(8) y(c)) select event_id, cast(sum(case when b and p > 0 then 1::hugeint << (63-p)::int else 0 end) - max(case when b and p = 0 then 9223372036854775808::hugeint else 0 end) as bigint) as dhash from b group by 1")
def dhash(spark, d):
    return fx.keyframes(spark, d).select("event_id", fr.dhash(_gray()).alias("dhash"))


_P = "list_transform(range(0, 72), lambda i: ((event_id*31 + i*i*7) % 97)::double)"


@query(ctes("kf") + f", p as (select event_id, {_P} as p from kf), s as (select event_id, list_transform(p, lambda x: (x - list_avg(p))/list_stddev_pop(p)) as s from p) select event_id, round(list_avg(list_transform(s, lambda x: abs(x))), 6) as away from s")
def region_signature_diff(spark, d):
    flat = F.array_repeat(F.lit(0.0), 72)
    return fx.keyframes(spark, d).select("event_id", F.round(fr.region_difference(fr.region_signature(_gray()), flat), 6).alias("away"))


@query("with recursive " + ctes("kf", "fp")[5:] + """, f as (select video_id, frame_idx, [floor(value/60), 0.0::double] as ti, [floor(value/60)*1.5::double] as tk, case when event_id % 9 > 0 then 't'||cast(event_id as varchar) else '' end as text from fp),
r as (select video_id, frame_idx, frame_idx as anchor, ti, tk, text from f where frame_idx = 0 union all
select f.video_id, f.frame_idx, case when near then r.anchor else f.frame_idx end, case when near then r.ti else f.ti end, case when near then r.tk else f.tk end, case when near then r.text else f.text end
from r join f on f.video_id = r.video_id and f.frame_idx = r.frame_idx + 1, lateral (select abs(f.ti[1]-r.ti[1])/2 < 1 and abs(f.tk[1]-r.tk[1]) < 2 and r.text <> '' as near) n)
select video_id, frame_idx, anchor, frame_idx <> anchor as reused, text from r""")
def reuse_duplicate_text(spark, d):
    v = F.floor(F.col("value") / 60).cast("double")
    f = fx.frame_predictions(spark, d).select("video_id", "frame_idx", F.array(v, F.lit(0.0)).alias("title"), F.array(v * 1.5).alias("ticker"), F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).otherwise("").alias("text"))
    return fr.reuse_duplicate_text(f, 1.0, 2.0)


@query(ctes("kf") + """, c as (select video_id, frame_id % 7 as frame_id, case when event_id % 2 = 0 then upper(event_type) else event_type end as text, value/500.0::double as confidence, 's'||cast(event_id % 3 as varchar) as source from kf),
g as (select video_id, frame_id, lower(text) as k, min(text) as text, max(least(1.0::double, greatest(0.0::double, confidence))) as confidence, count(distinct source) as sources from c group by all),
s as (select *, round(0.55::double*confidence + 0.15::double*least(1.0::double, sources/2.0::double) + 0.10::double*(0.65::double*1.0::double + 0.35::double*least(1.0::double, length(text)/12.0::double)) + 0.20::double*(case when k = 'click' then 0.4::double when k = 'view' then 0.2::double else 0.0::double end), 4) as score from g)
select video_id, frame_id, text, round(confidence, 3) as confidence, score, rank from (select *, row_number() over (partition by video_id, frame_id order by score desc, confidence desc, length(text) desc, k) as rank from s) where rank <= 5""")
def rank_text_candidates(spark, d):
    e = F.col("event_id")
    c = fx.keyframes(spark, d).select("video_id", (F.col("frame_id") % 7).alias("frame_id"), F.when(e % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("text"), (F.col("value") / 500.0).alias("confidence"), F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"), F.array(F.lit("Click"), F.lit("click"), F.lit("view")).alias("recent"))
    return fr.rank_text_candidates(c).withColumn("rank", F.col("rank").cast("long"))


@query(hybrid_sql("(query_id % 2 = 0 and not contains(text, chr(10)))"))
def hybrid_search_keywords(spark, d):
    """Every other query of one line quotes its words."""
    text = F.when((F.col("query_id") % 2 == 0) & ~F.contains("text", F.lit("\n")), F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return hybrid(spark, d, fx.queries(spark, d).withColumn("text", text))


@query(ctes("vx", "qv") + _KNN + ", s as (select query_id, video_id, frame_id, round(score + 1.0::double/(60+rank) + (case when contains(lower(video_id)||' '||cast(frame_id as varchar), 'src'||cast(query_id % 20 as varchar)) then 0.05::double else 0 end), 6) as score from kr where rank <= 500) select * from (select *, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from s) where rank <= 10")
def two_stage_retrieval(spark, d):
    v = fx.query_vectors(spark, d)
    q = v.select("query_id", F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string"), F.lit(" a")).alias("text"))
    return fu.two_stage(se.knn_search(v, fx.vectors(spark, d), 500), q).withColumn("rank", F.col("rank").cast("long"))


_KM = ctes("vx", "qv") + f""", l as (select query_id, case query_id % 4 when 0 then 'a red sign' when 1 then 'night in the dark' when 2 then 'a small cup with a pattern in close-up' else 'something else here' end as text from qv),
e as (select query_id, text, case query_id % 4 when 1 then 'mix' when 2 then 'dinov2' else 'clip' end as model from l),
kr as (select query_id, model, video_id, frame_id, score, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from (select query_id, model, video_id, frame_id, round(list_dot_product(qvec, vec), 6) as score from vx, qv join e using (query_id) where model = 'clip' or (model = 'dinov2' and vec_id % 2 = 0) or (model = 'mix' and vec_id % 3 = 0)))
select * from (select query_id, model, video_id, frame_id, score, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from (select query_id, model, video_id, frame_id, round(score + 1.0::double/(60+rank), 6) as score from kr where rank <= 500)) where rank <= 10"""


@query(_KM)
def two_stage_by_model(spark, d):
    """Three models, of which two know only some vectors; texts call for one of them, or for one that isn't there."""
    v, q = fx.vectors(spark, d), fx.query_vectors(spark, d)
    k = F.col("query_id") % 4
    asked = q.select("query_id", F.when(k == 0, "a red sign").when(k == 1, "night in the dark").when(k == 2, "a small cup with a pattern in close-up").otherwise("something else here").alias("text"))
    coarse = {"clip": v, "dinov2": v.where("vec_id % 2 = 0"), "mix": v.where("vec_id % 3 = 0")}
    return fu.two_stage_by_model({n: se.knn_search(q, x, 500) for n, x in coarse.items()}, asked).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_LOG}, s as (select query_id, text, {_STAGES('text')} as f from l), r as (select query_id, len(f) >= 2 as chained, case when len(f) >= 2 then f else [text] end as f from s) select query_id, chained, unnest(range(1, len(f)+1)) as stage, unnest(f) as text from r")
def auto_stages(spark, d):
    s = log(spark, d).withColumn("f", ql.split_stages(F.col("text"), ascii_bounds=True))
    many = F.size("f") >= 2
    s = s.select("query_id", many.alias("chained"), F.posexplode(F.when(many, F.col("f")).otherwise(F.array("text"))).alias("i", "text"))
    return s.select("query_id", "chained", (F.col("i") + 1).cast("long").alias("stage"), "text")


@query(ctes("vx", "qv") + """, m as (select query_id, vec_id % 2 = 0 as rel, vec from vx join qv on vx.vec_id between query_id and query_id + 3),
a as (select query_id, rel, i, avg(vec[i]) as x from m, range(1, 65) t(i) group by all), o as (select query_id, i, qvec[i] as x from qv, range(1, 65) t(i)),
c as (select o.query_id, o.i, o.x + 0.75::double*coalesce(r.x, 0) - 0.15::double*coalesce(n.x, 0) as x from o left join a r on r.query_id = o.query_id and r.i = o.i and r.rel left join a n on n.query_id = o.query_id and n.i = o.i and not n.rel),
q2 as (select query_id, list(x order by i) as u from c group by 1), q3 as (select query_id, list_transform(u, lambda x: x/sqrt(list_dot_product(u, u))) as qvec from q2)
select * from (select query_id, video_id, frame_id, score, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from (select query_id, video_id, frame_id, round(list_dot_product(qvec, vec), 6) as score from vx, q3)) where rank <= 10""")
def refine_search(spark, d):
    v, q = fx.vectors(spark, d), fx.query_vectors(spark, d)
    near = v.join(q.select("query_id"), F.floor(F.col("vec_id") / 25) * 25 == F.col("query_id")).where("vec_id - query_id <= 3")
    marked = near.select("query_id", F.concat_ws("_", "video_id", F.col("frame_id").cast("string")).alias("id"), (F.col("vec_id") % 2 == 0).alias("relevant"))
    return se.refine_search(q, marked, v, 10).withColumn("rank", F.col("rank").cast("long"))


_QA = ctes("vx", "dx", "qx") + """, vq as (select q.query_id, v.video_id, q.text, v.vec as qvec from qx q join vx v on v.vec_id = q.query_id),
nh as (select * from (select query_id, video_id, frame_id, score, row_number() over (partition by query_id order by score desc, video_id, frame_id) as r from (select query_id, vq.video_id, frame_id, round(list_dot_product(qvec, vec), 6) as score from vq join vx using (video_id))) where r <= 20),
th as (select query_id, video_id, frame_id, case when doc_id % 3 = 0 then 0.98::double else 0.99::double end as score from vq join dx using (video_id) where len(list_filter(string_split_regex(lower(vq.text), '\\s+'), lambda w: length(w) >= 3 and contains(lower(dx.text), w))) > 0 and (query_id, video_id, frame_id) not in (select query_id, video_id, frame_id from nh)),
vh as (select * from (select *, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from (select query_id, video_id, frame_id, score from nh union all select * from th)) where rank <= 20)"""


def _video_qa(spark, d):
    v = fx.vectors(spark, d)
    q = fx.queries(spark, d).join(v.select(F.col("vec_id").alias("query_id"), "video_id", F.col("vec").alias("qvec")), "query_id")
    x = fx.docs(spark, d)
    return q, se.video_qa(q, v, x.where("doc_id % 3 <> 0"), x.where("doc_id % 3 = 0"), 20)  # a third of the documents play speech


@query(_QA + " select * from vh")
def video_qa(spark, d):
    return _video_qa(spark, d)[1].withColumn("rank", F.col("rank").cast("long"))


@query(_QA + ", an as (select query_id, rank, left(string_split(trim(dx.text, ' '), chr(10))[1], 100) as answer from vh join dx using (video_id, frame_id) where rank <= 5) select query_id, arg_min(answer, rank) as answer, 'on_screen' as source from an where answer <> '' group by 1")
def qa_answer(spark, d):
    q, h = _video_qa(spark, d)
    t = fx.docs(spark, d).select("video_id", "frame_id", F.col("text").alias("on_screen"))
    return se.qa_answer(h.join(t, ["video_id", "frame_id"]).withColumn("spoken", F.lit("")), q)


@query(ctes("kf") + """, s as (select case when event_id % 20 < 10 then 'q'||cast(event_id % 20 as varchar)||'-qa.csv' else 'q'||cast(event_id % 20 as varchar)||'-kis.csv' end as file, event_id as line_no, case when event_id < 20 then 'Video,Frame' else video_id||'.MP4, '||cast(frame_id % 5 as varchar)||(case when event_id % 20 < 10 then ', '''||event_type||' "x"''' else '' end) end as line, video_id, frame_id % 5 as f, event_type from kf),
n as (select *, row_number() over (partition by file order by line_no) as n from s), k as (select *, n = 1 as header, case when n = 1 then 'Video,Frame' when contains(file, 'qa') then video_id||','||cast(f as varchar)||',"'||event_type||' '||repeat(chr(34), 2)||'x'||repeat(chr(34), 3) else video_id||','||cast(f as varchar) end as clean from n where n <= 100)
select file, line_no, clean as line, case when header then 'header' when row_number() over (partition by file, header, clean order by n) > 1 then 'repeated' end as problem from k""")
def validate_submission(spark, d):
    e, n = F.col("event_id"), F.col("event_id") % 20
    file = F.concat(F.lit("q"), n.cast("string"), F.when(n < 10, "-qa.csv").otherwise("-kis.csv"))
    answer = F.when(n < 10, F.concat(F.lit(", '"), "event_type", F.lit(" \"x\"'"))).otherwise("")
    line = F.when(e < 20, "Video,Frame").otherwise(F.concat("video_id", F.lit(".MP4, "), (F.col("frame_id") % 5).cast("string"), answer))
    return ss.validate_submission(fx.keyframes(spark, d).select(file.alias("file"), e.alias("line_no"), line.alias("line")))


@query(ctes("kf") + r""", s as (select event_id % 30 as q, event_id as line_no, case when event_id < 30 then 'Video,Frame' else video_id||(case when event_id % 4 = 0 then '.MP4' else '' end)||(case when event_id % 7 = 0 then '' when event_id % 30 < 10 then ', '||cast(frame_id % 5 as varchar)||', '''||repeat(event_type||' ', (event_id % 23)::int)||'"x"'''
when event_id % 30 < 20 then ','||(case when event_id % 11 = 0 then 'f' else '' end)||cast(frame_id as varchar) when event_id % 13 = 0 then ', none' else ','||cast(frame_id % 50 as varchar)||',bad,'||cast(frame_id % 7 as varchar)||',50' end) end as line from kf),
n as (select *, case when q < 10 then 'qa' when q < 20 then 'kis' else 'trake' end as k, row_number() over (partition by q order by line_no) as n from s), h as (select *, max(n = 1 and line = 'Video,Frame') over (partition by q) as headed from n where n <= 100),
p as (select *, string_split(line, ',') as p, n - headed::bigint as row from h where line <> 'Video,Frame'), t as (select *, ends_with(lower(p[1]), '.mp4') as mp4, list_filter([trim(x) for x in p[2:]], lambda x: regexp_full_match(x, '[0-9]+')) as f, left(trim(trim(list_aggregate(p[3:], 'string_agg', ','), ' '), ''''), 1000) as a from p)
select 'q'||q||'-'||k||'.csv' as file, row, (case when mp4 then left(p[1], length(p[1])-4) else p[1] end)||case when k = 'qa' and len(p) >= 3 then ','||trim(p[2])||',"'||replace(left(a, 100), '"', '""')||'"' when k = 'trake' and len(f) > 0 then ','||list_aggregate(list_transform(list_sort(list_distinct(list_transform(f, lambda x: x::bigint))), lambda x: x::varchar), 'string_agg', ',') when len(p) > 1 then ','||trim(p[2]) else '' end as line,
concat_ws('; ', case when mp4 then 'mp4' end, case when k = 'qa' and len(p) < 3 then 'no answer' when k = 'qa' and length(a) > 100 then 'long answer' end, case when k = 'trake' and len(f) < len(p)-1 then 'frame is no number' end) as warnings,
case when k <> 'qa' and len(p) < 2 then 'no frame' when k = 'kis' and len(f) = 0 then 'frame is no number' when k = 'trake' and len(f) = 0 then 'no frame' else '' end as errors from t""")
def submission_errors(spark, d):
    e, q, frame = F.col("event_id"), F.col("event_id") % 30, F.col("frame_id")
    text = lambda x: x.cast("string")
    file = F.concat(F.lit("q"), text(q), F.when(q < 10, "-qa.csv").when(q < 20, "-kis.csv").otherwise("-trake.csv"))
    answer = F.concat(F.lit(", "), text(frame % 5), F.lit(", '"), F.repeat(F.concat("event_type", F.lit(" ")), (e % 23).cast("int")), F.lit("\"x\"'"))
    one = F.concat(F.lit(","), F.when(e % 11 == 0, "f").otherwise(""), text(frame))
    chain = F.when(e % 13 == 0, ", none").otherwise(F.concat(F.lit(","), text(frame % 50), F.lit(",bad,"), text(frame % 7), F.lit(",50")))
    rest = F.when(e % 7 == 0, "").when(q < 10, answer).when(q < 20, one).otherwise(chain)
    line = F.when(e < 30, "Video,Frame").otherwise(F.concat("video_id", F.when(e % 4 == 0, ".MP4").otherwise(""), rest))
    return ss.submission_errors(fx.keyframes(spark, d).select(file.alias("file"), e.alias("line_no"), line.alias("line"))).withColumn("row", F.col("row").cast("long"))
