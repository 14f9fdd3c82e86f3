"""Queries over the driver's tables, one an operator, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimpse.functions import text as tx
from glimpse.operators import frames as fr
from glimpse.operators import fusion as fu
from glimpse.operators import search as se
from glimpse.operators import session as ss
from glimpse.plans import fixtures as fx
from glimpse.plans.fixtures import ctes
from glimpse.sources.layout import write_by_video
from glimpse.sources.readers import numbered, scratch

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
STOP = ("the", "of", "and", "de", "la")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- texts and names --------------------------------------------------------------------------------------------------

_TOK = "list_distinct(regexp_extract_all(lower(strip_accents(lower(text))), '[\\p{L}\\p{N}_]+'))"


@query("select doc_id, lower(strip_accents(lower(text))) as bare from documents")
def strip_accents(spark, d):
    return fx.docs(spark, d).select("doc_id", tx.strip_accents(F.col("text")).alias("bare"))


@query(f"select doc_id, len({_TOK}) as n, list_aggregate(list_sort({_TOK}), 'string_agg', ' ') as words from documents")
def word_tokens(spark, d):
    t = tx.word_tokens(F.col("text"))
    return fx.docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.nullif(F.array_join(F.array_sort(t), " "), F.lit("")).alias("words"))


_SPELL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.SPELLINGS.items()) + "}"


@query(f"""with c as (select doc_id, trim(regexp_replace(coalesce(text, '')||'  Duong NGUOI luong x_duong', '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) as c from documents),
w as (select doc_id, unnest(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) as w, generate_subscripts(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) as i from c),
f as (select *, {_SPELL}[lower(w)] as f from w)
select doc_id, string_agg(case when f is null then w when w = upper(w) then upper(f) when w[1] = upper(w[1]) then upper(f[1])||f[2:] else f end, '' order by i) as clean from f group by 1""")
def normalize_text(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("  Duong NGUOI luong x_duong"))
    return fx.docs(spark, d).select("doc_id", tx.normalize_text(text).alias("clean"))


@query(ctes("kf") + ", n as (select event_id, case event_id % 3 when 0 then 'Frame_'||event_type when 1 then 'KeyFrame_00'||cast(frame_id as varchar)||'.0' else cast(frame_id as varchar) end as name, frame_id from kf) select event_id, event_id % 3 = 0 as named, case when event_id % 3 > 0 then frame_id::double end as number, case when event_id % 3 = 0 then lower(name) end as name from n")
def frame_order_key(spark, d):
    number = F.col("frame_id").cast("string")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Frame_"), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("KeyFrame_00"), number, F.lit(".0"))).otherwise(number)
    k = fx.keyframes(spark, d).select("event_id", tx.frame_order_key(name).alias("k"))
    return k.select("event_id", "k.named", F.col("k.number").cast("double").alias("number"), "k.name")


@query(ctes("kf") + """, m as (select video_id, frame_id, min(seconds) as s from kf where event_id % 3 = 0 group by all)
select event_id, coalesce(m.s, case event_id % 3 when 1 then event_id / 100.0::double when 2 then kf.frame_id / 25.0::double end) as seconds from kf left join m on m.video_id = kf.video_id and m.frame_id = kf.frame_id""")
def resolve_timestamp(spark, d):
    """A third of the frames is on the map; other names hold the time beside the number, or the number alone, which goes by 25 frames a second."""
    k, e = fx.keyframes(spark, d), F.col("event_id")
    number, hundredths = F.col("frame_id").cast("string"), F.concat(F.expr("event_id div 100").cast("string"), F.lit("."), F.lpad((e % 100).cast("string"), 2, "0"))
    timed = F.concat(F.lit("b/ts_"), hundredths, F.lit("s_keyframe_00"), number, F.lit(".webp"))
    path = F.when(e % 3 == 1, timed).otherwise(F.concat(F.lit("a/keyframe_"), number, F.lit(".webp")))
    on_map = k.where("event_id % 3 = 0").select("video_id", "frame_id", "seconds")
    return fr.resolve_timestamp(k.select("event_id", "video_id", path.alias("path")), on_map, 25.0).select("event_id", "seconds")


@query(ctes("kf") + """ select event_id, case when event_id % 4 = 3 then 'L1_V2' else video_id end as video, frame_id as frame from kf""")
def extract_video_frame(spark, d):
    k, e = fx.keyframes(spark, d), F.col("event_id") % 4
    address = F.concat(F.lit("http://localhost:8000/keyframes/"), "video_id", F.lit("/keyframes/keyframe_"), F.col("frame_id").cast("string"), F.lit(".webp"))
    coded = F.concat(F.lit("x/L1_V2/keyframe_"), F.col("frame_id").cast("string"), F.lit(".webp"))
    none = F.lit(None).cast("string")
    item = tx.video_and_frame(F.when(e == 0, F.concat("video_id", F.lit(".mp4"))).when(e == 1, "localhost:8000"), F.when(e == 0, F.col("frame_id").cast("string")).otherwise("0"), F.when(e == 3, coded).when(e > 0, address), F.when(e == 2, F.concat("video_id", F.lit("-1.50"))), none)
    return k.select("event_id", item.alias("i")).select("event_id", "i.video", "i.frame")


@query(ctes("kf") + " select event_id, case when event_id % 3 = 0 then 2.5::double when event_id % 3 = 1 then value else 1.0::double end as score, case when event_id % 2 = 0 then event_id else round(frame_id/25.0::double*1000)::bigint end as ms from kf")
def display_hit(spark, d):
    e, none = F.col("event_id"), F.lit(None).cast("double")
    score = tx.display_score(F.when(e % 3 == 0, F.lit(2.5)), F.when(e % 3 == 1, F.col("value")), F.lit(1.0))
    return fx.keyframes(spark, d).select("event_id", score.alias("score"), tx.display_ms(F.when(e % 2 == 0, e), none, F.col("frame_id")).alias("ms"))


@query("select doc_id, round(case when length(text)=0 then 0.0::double else 0.65::double*length(regexp_replace(text, '[^\\p{L}\\p{N}\\s.,:;!?''\\-_/()%+&]', '', 'g'))/length(text) + 0.35::double*least(1.0::double, length(text)/12.0::double) end, 6) as quality from documents")
def text_quality(spark, d):
    return fx.docs(spark, d).select("doc_id", F.round(tx.text_quality(F.col("text")), 6).alias("quality"))


@query(ctes("kf") + ", m as (select *, cast(round(seconds*1000) as bigint) as ms from kf) select event_id, (case when ms//3600000 < 100 then lpad(cast(ms//3600000 as varchar),2,'0') else cast(ms//3600000 as varchar) end)||':'||lpad(cast(ms//60000%60 as varchar),2,'0')||':'||lpad(cast(ms//1000%60 as varchar),2,'0')||'.'||lpad(cast(ms%1000 as varchar),3,'0') as hms from m")
def format_hms(spark, d):
    return fx.keyframes(spark, d).select("event_id", tx.format_hms(F.col("seconds")).alias("hms"))


@query(ctes("kf") + " select event_id, (case when floor(seconds)//60 < 100 then lpad(cast(cast(floor(seconds) as bigint)//60 as varchar),2,'0') else cast(cast(floor(seconds) as bigint)//60 as varchar) end)||':'||lpad(cast(cast(floor(seconds) as bigint)%60 as varchar),2,'0') as ms from kf")
def format_ms(spark, d):
    return fx.keyframes(spark, d).select("event_id", tx.format_ms(F.col("seconds")).alias("ms"))


@query("select doc_id, source||'/keyframes/keyframe_'||cast(doc_id+1 as varchar)||'.webp' as key, source as video, doc_id+1 as frame from documents")
def doc_key(spark, d):
    k = fx.docs(spark, d).select("doc_id", tx.doc_key(F.col("video_id"), F.col("frame_id")).alias("key"))
    return k.select("doc_id", "key", tx.key_video(F.col("key")).alias("video"), tx.key_frame(F.col("key")).alias("frame"))


@query("select doc_id, case when doc_id % 5 = 0 then 'Frame_'||lang else cast(doc_id+1 as varchar) end as id from documents")
def canonical_frame_id(spark, d):
    """Numbers in several dresses, and every fifth name no number at all."""
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "keyframe_00").otherwise("FRAME_"), F.col("frame_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".0").otherwise(""))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" Frame_"), "lang", F.lit(" "))).otherwise(raw)
    return fx.docs(spark, d).select("doc_id", tx.canonical_frame_id(raw).alias("id"))


@query("select doc_id, doc_id+1 as frame from documents")
def parse_frame_id(spark, d):
    return fx.docs(spark, d).select("doc_id", tx.parse_frame_id(tx.doc_key(F.col("video_id"), F.col("frame_id"))).alias("frame"))


_NAMES = ("ts_{t}s", "TS-{t}_k", "ts{n}", "x_{n}MS", "{n}ms-x", "f{n}ms", "x_{t}", "{t}_x", "x_{n}", "none")


@query(ctes("kf") + f""", n as (select event_id, event_id // 100 || '.' || lpad((event_id % 100)::varchar, 2, '0') as t, event_id::varchar as n from kf),
p as (select event_id, case event_id % 10 {" ".join(f"when {i} then " + repr(x).replace("{t}", "'||t||'").replace("{n}", "'||n||'") for i, x in enumerate(_NAMES))} end as stem from n),
r as (select event_id, regexp_extract(stem, '{tx.NAMED_SECONDS}', 1) as a, regexp_extract(stem, '{tx.NAMED_MILLISECONDS}', 1) as b, regexp_extract(stem, '{tx.NAMED_POINT}', 1) as c from p)
select event_id, case when a <> '' then a::double when b <> '' then b::double / 1000 when c <> '' then c::double end as t from r""")
def timestamp_from_name(spark, d):
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    t = F.concat(F.expr("event_id div 100").cast("string"), F.lit("."), F.lpad((e % 100).cast("string"), 2, "0"))
    name = F.lit(None).cast("string")
    for i, x in enumerate(_NAMES):
        name = F.when(e % 10 == i, F.replace(F.replace(F.lit(x), F.lit("{t}"), t), F.lit("{n}"), n)).otherwise(name)
    return fx.keyframes(spark, d).select("event_id", tx.timestamp_from_name(F.concat(F.lit("a.b/"), name, F.lit(".webp"))).alias("t"))


@query(f"select doc_id, regexp_matches(lower(text), '{tx.VIETNAMESE}') as vi from documents")
def is_vietnamese(spark, d):
    return fx.docs(spark, d).select("doc_id", tx.is_vietnamese(F.col("text")).alias("vi"))


# --- frames -----------------------------------------------------------------------------------------------------------

_SC = ", sc as (select *, cast(sum(case when p > 0.5 and frame_idx > 0 then 1 else 0 end) over (partition by video_id order by frame_idx) as bigint) as scene_id from fp), s as (select video_id, scene_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as n_frames from sc group by all), sf as (select *, n_frames < 50 and count(*) over (partition by video_id) > 15 as fast from s)"


@query(ctes("kf", "fp") + _SC + " select video_id, frame_idx, scene_id from sc")
def segment_scenes(spark, d):
    return fr.segment_scenes(fx.frame_predictions(spark, d)).select("video_id", "frame_idx", "scene_id")


def _scenes(spark, d):
    return fr.fast_action(fr.scenes(fr.segment_scenes(fx.frame_predictions(spark, d))))


@query(ctes("kf", "fp") + _SC + " select * from sf")
def fast_action(spark, d):
    return _scenes(spark, d)


_TG = """, tg as (select video_id, scene_id, first_frame, last_frame, unnest(case
 when fast then (case when first_frame+8 <= last_frame-1 then range(first_frame+8, last_frame, 17) else [first_frame+n_frames//2] end)
 when n_frames/25.0 <= 2 then [first_frame+n_frames//2]
 when n_frames/25.0 <= 5 then [first_frame+cast(floor(n_frames*0.3::double) as bigint), first_frame+cast(floor(n_frames*0.7::double) as bigint)]
 else (case when first_frame+25 <= last_frame-1 then range(first_frame+25, last_frame, 87) else [first_frame+n_frames//2] end) end) as target_idx from sf)"""


@query(ctes("kf", "fp") + _SC + _TG + " select video_id, scene_id, target_idx from tg")
def target_frames(spark, d):
    return fr.target_frames(_scenes(spark, d))


@query(ctes("kf", "fp", "fs") + " select video_id, frame_idx, blur >= 70 and mean_lum between 20 and 238 and std_lum >= 15 and not (frame_idx < 4 and over_ratio > 0.28::double) as valid from fs")
def frame_quality_filter(spark, d):
    return fr.frame_quality(fx.frame_statistics(spark, d), edge=F.col("frame_idx") < 4).select("video_id", "frame_idx", "valid")


@query(ctes("kf", "fp", "fs") + _SC + _TG + """, j as (select tg.*, fs.frame_idx, blur as score, blur >= 70 and mean_lum between 20 and 238 and std_lum >= 15 as valid from tg join fs on fs.video_id = tg.video_id and fs.frame_idx between greatest(target_idx-3, first_frame) and least(target_idx+3, last_frame)),
k as (select *, min(case when valid and score > 200 then frame_idx end) over (partition by video_id, scene_id, target_idx) as stop from j),
r as (select *, row_number() over (partition by video_id, scene_id, target_idx order by valid desc, score desc, frame_idx) as r from k where stop is null or frame_idx <= stop)
select video_id, scene_id, target_idx, frame_idx, score from r where r = 1""")
def best_frame_in_window(spark, d):
    s = _scenes(spark, d)
    t = fr.target_frames(s).join(s.select("video_id", "scene_id", "first_frame", "last_frame"), ["video_id", "scene_id"])
    return fr.best_frame_in_window(t, fr.frame_quality(fx.frame_statistics(spark, d)))


@query(ctes("kf") + " select event_id, bit_count(xor(event_id*7919%4096, floor(value)::bigint))::bigint as bits from kf")
def hamming(spark, d):
    return fx.keyframes(spark, d).select("event_id", fr.hamming(F.col("event_id") * 7919 % 4096, F.floor("value").cast("long")).cast("long").alias("bits"))


@query("with recursive " + ctes("kf", "fp", "fh").removeprefix("with ") + """,
w(video_id, i, kept, hashes) as (select video_id, 0::bigint, [frame_idx], [dhash] from fh where frame_idx = 0
 union all select w.video_id, fh.frame_idx, case when near then w.kept else list_append(w.kept, fh.frame_idx) end, case when near then w.hashes else list_append(w.hashes, fh.dhash) end
 from (select w.*, fh.dhash as x, len(list_filter(w.hashes[-4:], lambda h: bit_count(xor(h, fh.dhash)) <= 2)) > 0 as near from w join fh on fh.video_id = w.video_id and fh.frame_idx = w.i + 1) w join fh on fh.video_id = w.video_id and fh.frame_idx = w.i + 1),
l as (select video_id, arg_max(kept, i) as k, arg_max(hashes, i) as h from w group by 1)
select video_id, unnest(k) as frame_idx, unnest(h) as dhash from l""")
def drop_near_duplicates(spark, d):
    return fr.drop_near_duplicates(fx.frame_hashes(spark, d), threshold=2)


@query(ctes("kf", "fp") + " select video_id, frame_idx+1 as frame_id, round(frame_idx/25.0::double,3) as seconds, cast(round(frame_idx/25.0::double*1000) as bigint) as timestamp_ms, 25.0::double as fps from fp")
def build_frame_map(spark, d):
    return fr.build_frame_map(fx.frame_predictions(spark, d))


@query(ctes("kf") + ", n as (select video_id, frame_id, event_id, seconds, lead(seconds) over (partition by video_id order by seconds, frame_id) as nx from kf) select video_id, frame_id, event_id, round(seconds,3) as interval_start, round(nx,3) as interval_end, round(coalesce((seconds+round(nx,3))/2, seconds),3) as midpoint from n")
def interval_timestamps(spark, d):
    return fr.interval_timestamps(fx.keyframes(spark, d)).select("video_id", "frame_id", "event_id", "interval_start", "interval_end", "midpoint")


@query(ctes("dx") + ", n as (select *, case when lag(lang) over (partition by video_id order by frame_id) is distinct from lang then 1 else 0 end as new from dx) select video_id, frame_id, cast(sum(new) over (partition by video_id order by frame_id) as bigint) as event_no from n")
def text_event_id(spark, d):
    return fr.text_event_id(fx.docs(spark, d), "lang").select("video_id", "frame_id", "event_no")


_SPOKEN = "case (conv_id + turn) % 5 when 0 then 'Uhm...' when 1 then 'Subtitles by, '||string_split(text, ' ')[1] when 2 then 'va, va! va va' when 3 then text||' phụ đề bởi' else text end"


@query(f"""with c as (select conv_id, turn, lower(trim(regexp_replace(coalesce({_SPOKEN}, ''), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))) as t, (conv_id*7%100)/100.0::double as ns, -(turn*13%20)/10.0::double as lp from conversations),
w as (select *, regexp_split_to_array(t, '\\s+') as ws from c) select conv_id, turn, ns > 0.65::double or lp < -1.3::double or length(t) < 2 or t in ('ừ', 'ờ', 'à', 'uhm', 'uh', 'ah', 'um', 'ồ', 'ê', 'hả', 'dạ', 'vâng') or (len(ws) >= 4 and len(list_distinct(ws)) = 1)
or (len(ws) <= 12 and len(list_filter(['hãy like và subscribe', 'đăng ký kênh để', 'nhấn chuông thông báo', 'phụ đề thực hiện bởi', 'phụ đề bởi', 'subtitles by', 'cảm ơn các bạn đã theo dõi', 'hẹn gặp lại trong các video'], lambda p: contains(t, p))) > 0) as junk from w""")
def junk_segment_filter(spark, d):
    """Turns dressed as speech: fillers, closing phrases in short and in long ones, one word over and over."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(k == 0, "Uhm...").when(k == 1, F.concat(F.lit("Subtitles by, "), F.split("text", " ")[0])).when(k == 2, "va, va! va va").when(k == 3, F.concat("text", F.lit(" phụ đề bởi"))).otherwise(F.col("text"))
    junk = fr.junk_segment(text, (F.col("conv_id") * 7 % 100) / 100.0, -(F.col("turn") * 13 % 20) / 10.0)
    return fx.table(spark, d, "conversations").select("conv_id", "turn", junk.alias("junk"))


def _segment_frames(spark, d):
    v = fx.segments(spark, d).where("not video_id like '%7'").select("video_id").distinct()  # the others have no frame map
    return v.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("k")).select("video_id", (F.col("k") + 1).alias("frame_id"), (F.col("k") * 7.5).alias("seconds"))


@query(ctes("sx") + """, g as (select distinct video_id, unnest(range(25)) as k from sx where video_id not like '%7'), f as (select video_id, k+1 as frame_id, k*7.5::double as seconds from g),
i as (select s.video_id, segment_id, frame_id, text from sx s join f on f.video_id = s.video_id and seconds between seg_start and seg_end),
a as (select * from sx where video_id not like '%7' and (video_id, segment_id) not in (select video_id, segment_id from i)),
c as (select a.video_id, segment_id, text, frame_id, abs(seconds-(seg_start+seg_end)/2) as dist, seconds >= seg_start as after_ from a join f on f.video_id = a.video_id
      where frame_id in ((select max(frame_id) from f g where g.video_id = a.video_id and g.seconds < a.seg_start), (select min(frame_id) from f g where g.video_id = a.video_id and g.seconds >= a.seg_start))),
n as (select video_id, segment_id, frame_id, text from (select *, row_number() over (partition by video_id, segment_id order by dist, after_ desc) as r from c) where r = 1),
z as (select video_id, segment_id, floor(seg_start*25)::bigint as frame_id, text from sx where video_id like '%7'),
u as (select video_id, frame_id, text, min(segment_id) as o from (select video_id, segment_id, frame_id, text from i union all select * from n union all select * from z) group by all)
select video_id, frame_id, string_agg(text, ' | ' order by o, text) as text from u group by all""")
def align_segments_to_frames(spark, d):
    return fr.align_segments(fx.segments(spark, d), _segment_frames(spark, d))


@query(ctes("sx") + " select video_id, string_agg(text, ' ' order by segment_id, text) as transcript from sx group by 1")
def transcript_per_video(spark, d):
    return fr.transcript(fx.segments(spark, d))


def _detections(spark, d):
    e, v = F.col("event_id"), F.col("value")
    box = F.array(e % 10 / 10.0, e % 7 / 10.0, e % 10 / 10.0 + 0.2, e % 7 / 10.0 + 0.1)
    k = fx.keyframes(spark, d).select("video_id", "frame_id", F.array("event_type", F.lit("person")).alias("labels"), F.array(e % 100 / 100.0, F.lit(0.9)).alias("scores"), F.array(box, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.5))).alias("boxes"))
    return fr.explode_detections(k)


_DET = ", det as (select video_id, frame_id, event_type as label, event_id%100/100.0::double as score, (event_id%7)/10.0::double as x, (event_id%10)/10.0::double as y from kf where event_id%100/100.0::double > 0.4::double union all select video_id, frame_id, 'person', 0.9::double, 0.2::double, 0.1::double from kf)"


@query(ctes("kf") + _DET + " select * from det")
def explode_detections(spark, d):
    return _detections(spark, d).select("video_id", "frame_id", "label", "score", "x", "y")


@query(ctes("kf") + _DET + " select video_id, frame_id, count(*) as n from det where label = 'person' group by all having count(*) >= 1")
def object_count_filter(spark, d):
    return fr.object_count_filter(_detections(spark, d), "person", 1)


@query(ctes("kf") + ", m as (select *, case when value < 5 then null else seconds end as t, event_type||cast(event_id as varchar) as path from kf), b as (select *, bool_or(t is null) over (partition by video_id) as missing from m) select event_id, row_number() over (partition by video_id order by case when not missing then t end, frame_id, path) as nth from b")
def order_frames(spark, d):
    k = fx.keyframes(spark, d).withColumn("seconds", F.when(F.col("value") >= 5, F.col("seconds"))).withColumn("path", F.concat("event_type", F.col("event_id").cast("string")))
    return fr.order_frames(k).select("event_id", F.col("nth").cast("long").alias("nth"))


@query("select coalesce(a.source, b.source) as video_id, coalesce(a.doc_id, b.doc_id)+1 as frame_id, coalesce(a.lang, '') as ocr_text, coalesce(b.source, '') as asr_text from (select * from documents where doc_id%3<>0) a full join (select * from documents where doc_id%2=0) b on a.doc_id = b.doc_id")
def merge_metadata(spark, d):
    x = fx.docs(spark, d)
    return fr.merge_metadata(x.where("doc_id % 3 != 0").withColumn("text", F.col("lang")), x.where("doc_id % 2 = 0").withColumn("text", F.col("video_id")))


@query(ctes("kf") + ", l as (select video_id, frame_id//100 as frame_id, event_type as text, value/600.0::double as conf, event_id as y from kf) select video_id, frame_id, string_agg(text, ' | ' order by y, lower(text)) as text, round(avg(conf), 3) as confidence from l where length(text) >= 2 and conf >= 0.25::double group by all")
def assemble_lines(spark, d):
    l = fx.keyframes(spark, d).select("video_id", F.floor(F.col("frame_id") / 100).cast("long").alias("frame_id"), F.col("event_type").alias("text"), (F.col("value") / 600.0).alias("conf"), F.col("event_id").alias("y"))
    return fr.assemble_lines(l)


@query(ctes("dx", "vx") + ", f as (select video_id, frame_id, row_number() over (partition by video_id order by lpad(cast(frame_id as varchar),9,'0'))-1 as pos from dx where lang is not null and doc_id % 7 <> 3), v as (select video_id, row_number() over (partition by video_id order by vec_id)-1 as pos, vec_id from vx) select video_id, frame_id, pos, vec_id from f join v using (video_id, pos)")
def align_vectors_by_rank(spark, d):
    v = fx.vectors(spark, d).withColumn("pos", (F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1).cast("long")).select("video_id", "pos", "vec_id")
    f = fx.docs(spark, d).withColumn("name", F.lpad(F.col("frame_id").cast("string"), 9, "0"))
    # documents without a language, and every seventh, play unreadable frames
    return fr.align_vectors_by_rank(f.withColumn("read", F.col("lang").isNotNull() & (F.col("doc_id") % 7 != 3)), v, readable="read")


@query(ctes("kf") + ", n as (select video_id, frame_id, row_number() over (partition by video_id order by frame_id) as r from kf), a as (select k.video_id, k.frame_id as anchor, n.r from kf k join n using (video_id, frame_id)) select a.video_id, anchor, n.frame_id, n.r - a.r as \"offset\" from a join n on n.video_id = a.video_id and n.r between a.r-2 and a.r+2")
def neighbor_frames(spark, d):
    k = fx.keyframes(spark, d)
    return fr.neighbour_frames(k, k.select("video_id", "frame_id"), 2)


# --- search -----------------------------------------------------------------------------------------------------------

#: A small dictionary over the test tables' words; users bring their own.
SYN = {"the": ["that", "one"], "una": ["un"], "und": ["mit der"], "les": ["des"]}


_BARE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _lex(p: str, q: str, x: str, stop: tuple[str, ...], syn: dict[str, list[str]] | None = None) -> str:
    """The tables of a lexical search of queries ``q`` in documents ``x``, their names with ``p`` before them."""
    words = "(" + ", ".join(f"'{w}'" for w in stop) + ")"
    more = ", ".join(f"case when contains(lower(strip_accents(lower({_BARE}))), '{k}') then [{', '.join(repr(w) for w in dict.fromkeys(' '.join(v).split()))}] else [] end" for k, v in (syn or {}).items())
    return f""", {p}po as (select video_id, frame_id, unnest({_TOK}) as token from {x}), {p}dl as (select video_id, frame_id, len({_TOK}) as n from {x}), {p}av as (select count(*) as n_docs, sum(n)::double/greatest(count(*),1) as avgdl from {p}dl where n > 0),
{p}qt0 as (select query_id, {_TOK} as t, list_filter(flatten([[]::varchar[]{', ' + more if more else ''}]), lambda x: x not in {words}) as more from {q}),
{p}qw as (select query_id, case when len(list_filter(t, lambda x: x not in {words})) > 0 then list_filter(t, lambda x: x not in {words}) else t end as own, more from {p}qt0),
{p}qt as (select query_id, unnest(list_distinct(list_concat(own, more))) as token from {p}qw), {p}nq as (select query_id, count(*) as n_query from {p}qt group by 1),
{p}df as (select token, count(*) as df from {p}po where token in (select token from {p}qt) group by 1),
{p}bm as (select t.query_id, o.video_id, o.frame_id, sum(ln((n_docs-df+0.5::double)/(df+0.5::double)+1)) as idf, count(*) as shared from {p}qt t join {p}po o using (token) join {p}df using (token), {p}av group by all),
{p}bs as (select query_id, video_id, frame_id, round(idf*2.2::double/(1+1.2::double*(1-0.75::double+0.75::double*n/greatest(avgdl,1.0::double))), 6) as score, shared, n, n_query from {p}bm join {p}dl using (video_id, frame_id) join {p}nq using (query_id), {p}av),
{p}xp as materialized (select video_id, frame_id, lower({_BARE}) as d, lower(strip_accents(lower({_BARE}))) as da from {x}), {p}qp as materialized (select query_id, lower({_BARE}) as q, lower(strip_accents(lower({_BARE}))) as qa from {q}),
{p}ta as (select b.*, q, qa, d, da, shared::double/n_query as p, shared::double/greatest(n,1) as r from {p}bs b join {p}qp using (query_id) join {p}xp using (video_id, frame_id)),
{p}ts as (select query_id, video_id, frame_id, round(case when q = d then 1.0::double when contains(d, q) then 0.95::double+0.05::double*length(q)/greatest(length(d),1)
 when length(d) >= 3 and contains(q, d) then 0.90::double+0.05::double*length(d)/greatest(length(q),1)
 when contains(da, qa) then 0.88::double+0.08::double*length(qa)/greatest(length(da),1)
 when length(da) >= 3 and contains(qa, da) then 0.82::double+0.08::double*length(da)/greatest(length(qa),1)
 else round(least(0.70::double+0.20::double*least(score/3,1.0::double)+0.10::double*(2*p*r/(p+r)), 0.96::double),3) end, 3) as s from {p}ta),
{p}tr as (select query_id, video_id, frame_id, s as score, row_number() over (partition by query_id order by s desc, video_id, frame_id) as rank from {p}ts where s >= 0.65::double)"""


_POST = _lex("", "qx", "dx", STOP)
_LEX = ctes("dx", "qx") + _POST
_TIER = _QT = _BM = ""


@query(_LEX + " select * from po")
def build_postings(spark, d):
    return se.build_postings(fx.docs(spark, d))


@query(_LEX + " select video_id, frame_id, n from dl")
def doc_lengths(spark, d):
    return se.doc_lengths(fx.docs(spark, d).where("text is not null"))


@query(_LEX + " select n_docs, round(avgdl, 6) as avgdl from av")
def corpus_avgdl(spark, d):
    return se.corpus_average(fx.docs(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(_LEX + " select * from bs")
def bm25_binary(spark, d):
    return se.bm25_binary(fx.queries(spark, d), fx.docs(spark, d), STOP).withColumn("n_query", F.col("n_query"))


@query(_LEX.replace("qx as (select item_id::bigint as query_id, text from benchmark)", "qx as (select item_id::bigint as query_id, case when item_id % 20 = 0 then 'zzqx' else text end as text from benchmark)") + ", sw as (select distinct query_id, video_id, frame_id from po join qt using (token)) select * from sw union all select query_id, video_id, frame_id from qx, dx where query_id not in (select query_id from sw)")
def candidate_docs(spark, d):
    """Every twentieth query is a word that no document has."""
    q = fx.queries(spark, d).withColumn("text", F.when(F.col("query_id") % 20 == 0, "zzqx").otherwise(F.col("text")))
    return se.candidate_docs(q, fx.docs(spark, d), STOP)


@query(ctes("dx", "qx") + _lex("", "qx", "dx", STOP, SYN) + " select * from tr where rank <= 1000")
def search_ocr(spark, d):
    return se.search_ocr(fx.queries(spark, d), fx.docs(spark, d), stop_words=STOP, synonyms=SYN).withColumn("rank", F.col("rank").cast("long"))


@query(ctes("dx", "qx") + _lex("", "qx", "dx", se.SPEECH_STOP, SYN) + " select * from tr where rank <= 1000")
def search_asr(spark, d):
    """Documents stand for speech, as segments are too short to hold a query's words."""
    return se.search_asr(fx.queries(spark, d), fx.docs(spark, d), synonyms=SYN).withColumn("rank", F.col("rank").cast("long"))


_DOT = "round(list_sum(list_transform(range(1, len(vec)+1), lambda i: qvec[i]*vec[i])), 6)"
_KNN = ", kr as (select query_id, video_id, frame_id, score, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from (select query_id, video_id, frame_id, round(list_dot_product(qvec, vec), 6) as score from vx, qv))"


@query(ctes("vx", "qv") + _KNN + " select * from kr where rank <= 10")
def knn_search(spark, d):
    return se.knn_search(fx.query_vectors(spark, d), fx.vectors(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(ctes("vx", "qv") + _KNN.replace("from vx, qv", "from vx, qv where video_id = 'src0'") + " select * from kr where rank <= 10")
def knn_in_video(spark, d):
    return se.knn_search(fx.query_vectors(spark, d), fx.vectors(spark, d), 10, scope="src0").withColumn("rank", F.col("rank").cast("long"))


@query(ctes("vx") + " select vec_id, round(sqrt(list_dot_product(vec, vec)), 6) as before, 1.0::double as after from vx")
def l2_normalize(spark, d):
    v = F.col("vec")
    n = se.l2_normalize(F.transform(v, lambda x: x * 3))
    return fx.vectors(spark, d).select("vec_id", F.round(F.sqrt(se.dot(v, v)), 6).alias("before"), F.round(F.sqrt(se.dot(n, n)), 6).alias("after"))


@query(ctes("vx") + """, c as (select vec_id, vec[1:32] as v, 32 as d from vx union all select vec_id, list_concat(list_transform(vec, lambda x: x*0.85::double), list_transform(range(32), lambda i: 0.0::double)), 96 from vx),
n as (select vec_id, d, v, sqrt(list_dot_product(v, v)) as n from c) select vec_id, d as size, unnest(range(1, d+1)) as i, round(unnest(v)/n, 6) as x from n""")
def adapt_dimension(spark, d):
    """Cut to 32 components and filled up to 96, each component."""
    v = fx.vectors(spark, d)
    one = lambda n: v.select("vec_id", F.lit(n).cast("int").alias("size"), F.posexplode(se.adapt_dimension(F.col("vec"), n)).alias("i", "x"))
    return one(32).unionByName(one(96)).select("vec_id", "size", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(ctes("vx") + " select upper(video_id)||'_'||cast(frame_id as varchar) as id, video_id, frame_id, unnest(range(1, len(vec)+1)) as i, round(unnest(vec), 6) as x from vx")
def lookup_vectors(spark, d):
    v = fx.vectors(spark, d)
    ids = v.select(F.concat(F.upper("video_id"), F.lit("_"), F.col("frame_id").cast("string")).alias("id"))
    return se.lookup_vectors(ids, v).select("id", "video_id", "frame_id", F.posexplode("vec").alias("i", "x")).select("id", "video_id", "frame_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(ctes("vx") + ", b as (select a.vec_id, list_transform(range(1,65), lambda i: 0.45::double*a.vec[i]+0.55::double*b.vec[i]) as v from vx a join vx b on b.vec_id = a.vec_id + 1) select vec_id, unnest(range(1, 65)) as i, round(unnest(v)/sqrt(list_dot_product(v,v)), 6) as x from b")
def blend_vectors(spark, d):
    v = fx.vectors(spark, d).select("vec_id", "vec")
    o = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    m = v.join(o, "vec_id").select("vec_id", se.blend_vectors(F.col("vec"), F.col("other")).alias("v"))
    return m.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(ctes("vx", "qv") + """, f as (select label as query_id, vec_id % 3 <> 0 as rel, vec from vx), m as (select query_id, rel, i, avg(vec[i]) as x from f, range(1,65) t(i) group by all),
q as (select label as query_id, arg_min(vec, vec_id) as qvec from vx group by 1),
c as (select q.query_id, i, qvec[i] + 0.75::double*coalesce((select x from m where m.query_id = q.query_id and rel and m.i = t.i), 0) - 0.15::double*coalesce((select x from m where m.query_id = q.query_id and not rel and m.i = t.i), 0) as x from q, range(1,65) t(i)),
n as (select query_id, sqrt(sum(x*x)) as n from c group by 1) select c.query_id::bigint as query_id, i as i, round(x/n, 6) as x from c join n using (query_id)""")
def rocchio(spark, d):
    v = fx.vectors(spark, d).withColumn("query_id", F.col("label").cast("long"))
    q = v.groupBy("query_id").agg(F.min_by("vec", "vec_id").alias("qvec"))
    out = se.rocchio(q, v.select("query_id", (F.col("vec_id") % 3 != 0).alias("relevant"), "vec"))
    return out.select("query_id", F.posexplode("qvec").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(ctes("vx", "qv", "dx") + _KNN + " select query_id, video_id, frame_id, rank, coalesce(length(dx.text), 0) as n, round(frame_id/25.0::double, 3) as seconds from kr left join dx using (video_id, frame_id) where rank <= 5")
def search_similar(spark, d):
    h = se.knn_search(fx.query_vectors(spark, d), fx.vectors(spark, d), 5)
    none = fx.docs(spark, d).select("video_id", "frame_id", F.lit(None).cast("double").alias("seconds"))
    return se.enrich_hits(h, fx.docs(spark, d), none).select("query_id", "video_id", "frame_id", F.col("rank").cast("long").alias("rank"), F.length("text").cast("long").alias("n"), "seconds")


# --- fusion, chains ---------------------------------------------------------------------------------------------------

_FQ = ", kr1 as (select query_id // 25 as query_id, video_id, frame_id, rank from kr where rank <= 100), t1 as (select query_id, video_id, frame_id, rank from tr where rank <= 100)"
_RRF = ", rf0 as (select query_id, video_id, frame_id, {a}::double/(60+rank) as s from kr1 union all select query_id, video_id, frame_id, {b}::double/(60+rank) from t1), rf as (select query_id, video_id, frame_id, round(sum(s), 6) as score from rf0 group by all), rr as (select *, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from rf)"
_HYB = ctes("dx", "qx", "vx", "qv") + _POST + _QT + _BM + _TIER + _KNN + _FQ


def _branches(spark, d):
    knn = se.knn_search(fx.query_vectors(spark, d), fx.vectors(spark, d), 100).withColumn("query_id", F.floor(F.col("query_id") / 25).cast("long"))
    return {"visual": knn, "ocr": se.search_text(fx.queries(spark, d), fx.docs(spark, d), STOP, limit=100)}


def hybrid_sql(quoted: str) -> str:
    """Fusing of nearest frames, on-screen text and speech; ``quoted`` tells which queries name their words for on-screen text."""
    asked = f"case when {quoted} then '\"'||text||'\"' else text end"
    return ctes("dx", "qx", "vx", "qv") + f""", sx_ as (select * from dx where doc_id % 3 = 0), ox_ as (select * from dx where doc_id % 3 <> 0), qs_ as (select query_id, {asked} as text from qx), qq as (select query_id, {quoted} as quoted from qx)""" + _lex("", "qx", "ox_", STOP, SYN) + _lex("s", "qs_", "sx_", se.SPEECH_STOP, SYN) + _KNN + """,
hb as (select query_id // 25 as query_id, video_id, frame_id, rank, 1.0::double as w from kr where rank <= 50 and query_id // 25 in (select query_id from qx) union all select query_id, video_id, frame_id, rank, case when quoted then 1.15::double else 0.9::double end from tr join qq using (query_id) where rank <= 50 union all select query_id, video_id, frame_id, rank, 0.85::double from str where rank <= 50),
hw as (select distinct query_id from (select query_id from tr union all select query_id from str)),
hf as (select query_id, video_id, frame_id, round(sum(w/(60+rank)), 6) as score from hb where query_id in (select query_id from hw) group by all)
select query_id, video_id, frame_id, score, rank, 'rrf' as score_kind from (select *, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from hf) where rank <= 50
union all select k.query_id // 25, video_id, frame_id, score, rank, 'cosine' from kr k where rank <= 50 and k.query_id // 25 in (select query_id from qx) and k.query_id // 25 not in (select query_id from hw)"""


def hybrid(spark, d, queries):
    """A third of the documents play speech, the others on-screen text."""
    x = fx.docs(spark, d)
    v = fx.query_vectors(spark, d).withColumn("query_id", F.floor(F.col("query_id") / 25).cast("long"))
    h = fu.hybrid_search(queries, v, fx.vectors(spark, d), x.where("doc_id % 3 <> 0"), x.where("doc_id % 3 = 0"), 50, {"stop_words": STOP, "synonyms": SYN}, {"synonyms": SYN})
    return h.withColumn("rank", F.col("rank").cast("long"))


@query(hybrid_sql("false"))
def hybrid_search(spark, d):
    return hybrid(spark, d, fx.queries(spark, d))


@query(_HYB + _RRF.format(a="1.0", b="1.0") + " select * from rr where rank <= 100")
def rrf_plain(spark, d):
    b = _branches(spark, d)
    return fu.rrf_plain(b["visual"], b["ocr"]).withColumn("rank", F.col("rank").cast("long"))


@query(_LEX + _TIER + """, rw as (select query_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 2) as ws from qx),
rs as (select query_id, video_id, frame_id, round(score + 1.0::double/(60+rank) + 0.05::double*len(list_filter(ws, lambda w: contains(lower(video_id)||' '||cast(frame_id as varchar), w))), 6) as score from tr join rw using (query_id) where rank <= 500)
select * from (select *, row_number() over (partition by query_id order by score desc, video_id, frame_id) as rank from rs) where rank <= 10""")
def rerank(spark, d):
    h = se.search_text(fx.queries(spark, d), fx.docs(spark, d), STOP, limit=500)
    return fu.rerank(h, fx.queries(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(_HYB + ", u as (select query_id, video_id, frame_id, 1 as source, rank from t1 union all select query_id, video_id, frame_id, 2, rank from kr1), o as (select query_id, video_id, frame_id, min(source) as source, arg_min(rank, source) as r from u group by all) select query_id, video_id, frame_id, source, row_number() over (partition by query_id order by source, r, video_id, frame_id) as rank from o")
def priority_merge(spark, d):
    b = _branches(spark, d)
    return fu.priority_merge(b["ocr"], b["visual"]).withColumn("rank", F.col("rank").cast("long"))


def _chain_sql(n: int = 3) -> str:
    out = ctes("kf", "sh") + ", hv as (select video_id from sh group by 1 having count(distinct stage) >= 2), h as (select sh.* from sh join hv using (video_id)), l0 as (select distinct video_id, -1::bigint as last from h)"
    for i in range(1, n + 1):
        out += f", c{i} as (select h.*, frame_id > last as b from h join l{i - 1} using (video_id) where stage = {i}), d{i} as (select *, bool_or(b) over (partition by video_id) as a from c{i}), s{i} as (select * from (select video_id, stage, frame_id, score, row_number() over (partition by video_id order by score desc, frame_id) as r from d{i} where b = a) where r <= 2), l{i} as (select video_id, coalesce((select max(frame_id) from s{i} where s{i}.video_id = l{i - 1}.video_id), last) as last from l{i - 1})"
    out += ", tk as (" + " union all ".join(f"select * from s{i}" for i in range(1, n + 1)) + f"), pb as (select video_id, stage, max(score) as best from tk group by all), pv as (select video_id, sum(best) as total, count(*) as matched from pb group by 1 having count(*) >= 2), cv as (select video_id, round(total + 2.0::double*matched/{n}, 6) as chain_score from pv), cr as (select *, row_number() over (order by chain_score desc, video_id) as video_rank from cv), ch as (select 1::bigint as query_id, tk.video_id, stage, frame_id, chain_score, video_rank from tk join cr using (video_id) where video_rank <= 20)"
    return out


@query(_chain_sql() + " select * from ch")
def temporal_chain(spark, d):
    return fu.temporal_chain(fx.stage_hits(spark, d), 3).withColumn("video_rank", F.col("video_rank").cast("long"))


@query(_chain_sql() + ", few as (select * from ch where video_rank <= 3), ex as (select video_id, frame_id, row_number() over (order by score desc, video_id, frame_id) as r from sh where stage = 1 and (video_id, frame_id) not in (select video_id, frame_id from few)) select query_id, video_id, frame_id, stage from few union all select 1, video_id, frame_id, 1 from ex where (select count(*) from few) < 40 and r + (select count(*) from few) <= 200")
def temporal_chain_fallback(spark, d):
    h = fx.stage_hits(spark, d)
    return fu.chain_fallback(fu.temporal_chain(h, 3, top_videos=3), h)


@query(_LEX + _TIER + ", g as (select *, min(rank) over (partition by query_id, video_id) as f from tr where rank <= 100) select query_id, video_id, frame_id, rank, dense_rank() over (partition by query_id order by f) as video_place, row_number() over (partition by query_id, video_id order by rank) as place from g")
def group_by_video(spark, d):
    h = fu.group_by_video(se.search_text(fx.queries(spark, d), fx.docs(spark, d), STOP, limit=100))
    return h.select("query_id", "video_id", "frame_id", *[F.col(c).cast("long").alias(c) for c in ("rank", "video_place", "place")])


@query(ctes("kf") + ", t as (select video_id, seconds + 1000 as \"at\" from kf), c as (select t.video_id, \"at\", frame_id, row_number() over (partition by t.video_id, \"at\" order by abs(seconds-\"at\"), seconds, frame_id) as r from t join kf using (video_id)) select video_id, \"at\", frame_id from c where r = 1")
def nearest_keyframe(spark, d):
    k = fx.keyframes(spark, d)
    return fu.nearest_keyframe(k, k.select("video_id", (F.col("seconds") + 1000).alias("at")))


@query(_LEX + _TIER + " select query_id, video_id, frame_id, rank from tr where rank <= case when query_id % 2 = 0 then 200 else 80 end")
def display_limit(spark, d):
    h = se.search_text(fx.queries(spark, d), fx.docs(spark, d), STOP).withColumn("stage", F.when(F.col("query_id") % 2 == 0, 1))
    return fu.display_limit(h).select("query_id", "video_id", "frame_id", F.col("rank").cast("long").alias("rank"))


@query(ctes("kf") + " select event_id, greatest(0.0::double, seconds-2) as start from kf")
def preroll(spark, d):
    return fx.keyframes(spark, d).select("event_id", F.greatest(F.lit(0.0), F.col("seconds") - 2).alias("start"))


# --- sessions, submissions, work --------------------------------------------------------------------------------------


@query("select source as video_id, doc_id+1 as frame_id, case when doc_id%5=0 then 'v2' when doc_id%4=0 then 'v1' else lang end as text from documents")
def upsert_docs(spark, d):
    x = fx.docs(spark, d)
    up = x.where("doc_id % 4 = 0").select("video_id", "frame_id", F.lit("v1").alias("text"), F.lit(1).cast("long").alias("seq")).unionByName(x.where("doc_id % 5 = 0").select("video_id", "frame_id", F.lit("v2").alias("text"), F.lit(2).cast("long").alias("seq")))
    return ss.upsert_docs(x.withColumn("text", F.col("lang")), up)


@query(ctes("kf", "sx") + " select distinct video_id from kf where video_id not in (select video_id from kf where value > 480)")
def pending_work(spark, d):
    k = fx.keyframes(spark, d)
    return ss.pending_work(k.select("video_id").distinct(), k.where("value > 480"))


@query(ctes("kf") + """, r as (select *, row_number() over (order by event_id) - 1 as i from kf), l as (select 'log'||cast(i // 500 as varchar) as log, i as line_no, case when i % 97 = 0 then null else 'V'||cast((i // 6) % 400 as varchar) end as video_id, event_type as text, i % 6 = 5 and (i // 6) % 4 <> 0 as done from r),
n as (select *, case when lag(line_no) over w is null or video_id is distinct from lag(video_id) over w or coalesce(lag(done) over w, false) then 1 else 0 end as new from l window w as (partition by log order by line_no)),
b as (select *, sum(new) over (partition by log order by line_no) as block from n), g as (select log, block, video_id, max(line_no) as e from b where video_id is not null group by all having bool_or(done)),
m as (select video_id, log, block from (select *, row_number() over (partition by video_id order by log desc, e desc) as r from g) where r = 1) select video_id, line_no, text from b join m using (video_id, log, block) where not done""")
def latest_complete_block(spark, d):
    """Logs of 500 lines, six a video, of which most blocks end well; some lines can't be read."""
    k = numbered(fx.keyframes(spark, d).select("event_id", "event_type"), "event_id", "i")
    video = F.when(F.col("i") % 97 != 0, F.concat(F.lit("V"), (F.floor(F.col("i") / 6) % 400).cast("string")))
    done = (F.col("i") % 6 == 5) & (F.floor(F.col("i") / 6) % 4 != 0)
    return ss.latest_complete_block(k.select(F.concat(F.lit("log"), F.floor(F.col("i") / 500).cast("string")).alias("log"), F.col("i").alias("line_no"), video.alias("video_id"), F.col("event_type").alias("text"), done.alias("done")), stretch=70)


@query(ctes("sx") + " select video_id, count(*) as n_segments, count(*) filter (length(trim(text)) > 0) as n_ok, count(*) filter (length(trim(text)) = 0) as n_empty, max(seg_end) as duration from sx group by 1")
def run_summary(spark, d):
    return ss.run_summary(fx.segments(spark, d))


@query("select 'ocr' as kind, count(*) as n_rows from documents union all select 'asr', count(*) from conversations union all select 'vectors', count(*) from embeddings")
def corpus_stats(spark, d):
    t = lambda n: fx.table(spark, d, n)
    return ss.corpus_stats(ocr=t("documents"), asr=t("conversations"), vectors=t("embeddings"))


def _turns(spark, d):
    c = fx.table(spark, d, "conversations").where("role = 'user'")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    vids = F.array(*[F.concat(F.lit("v"), ((F.col("conv_id") * k + F.col("turn")) % 20).cast("string")) for k in range(1, 6)])
    return c.select(F.col("conv_id").cast("long").alias("session_id"), n.alias("turn_no"), "text", vids.alias("videos"))


_TURN = "tu as (select conv_id::bigint as session_id, row_number() over (partition by conv_id order by turn) as turn_no, text, list_transform(range(1,6), lambda k: 'v'||cast((conv_id*k+turn)%20 as varchar)) as videos from conversations where role = 'user'), tv as (select session_id, turn_no, unnest(videos) as video_id, unnest(range(5)) as i from tu)"


@query(f"with {_TURN} select session_id, video_id, count(*) as n, round(sum(1.0::double/turn_no), 6) as weight from tv group by all")
def conversation_video_counts(spark, d):
    return ss.video_counts(_turns(spark, d))


@query(f"with {_TURN}, c as (select session_id, video_id, count(*) as n, min(turn_no*10+i) as f from tv group by all), r as (select *, row_number() over (partition by session_id order by n desc, f) as r from c), l as (select *, row_number() over (partition by session_id order by turn_no desc) as b from tu) select session_id, (select count(*) from tu where tu.session_id = s.session_id) as n_turns, (select string_agg(text, ' // ' order by turn_no) from l where l.session_id = s.session_id and b <= 3) as last_queries, (select string_agg(video_id, ',' order by r) from r where r.session_id = s.session_id and r <= 3) as focus_videos from (select distinct session_id from tu) s")
def conversation_memory(spark, d):
    return ss.conversation_memory(_turns(spark, d))


@query("with h as (select user_id::bigint as \"user\", event_type as query, max(epoch_us(ts)) as \"at\" from events group by all) select \"user\", query, row_number() over (partition by \"user\" order by \"at\" desc, query) as place from h qualify place <= 3")
def query_history(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    log = fx.table(spark, d, "events").select(F.col("user_id").cast("long").alias("user"), F.col("event_type").alias("query"), us.alias("at"))
    return ss.query_history(log, 3).withColumn("place", F.col("place").cast("long"))


def _selection(spark, d):
    k = fx.keyframes(spark, d)
    return k.select((F.col("event_id") % 20).alias("query_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lower("video_id"), F.lit(".MP4"))).otherwise(F.col("video_id")).alias("video_id"), F.when(F.col("event_id") % 20 == 19, 0).otherwise(F.col("frame_id") % 5).alias("frame_id"), F.when(F.col("event_id") % 20 < 10, "kis").otherwise("trake").alias("task"), (F.floor(F.col("event_id") / 20) % 30).alias("candidate"))


_SEL = ", se as (select event_id % 20 as query_id, event_id as seq, case when event_id % 3 = 0 then lower(video_id) else video_id end as video_id, case when event_id % 20 = 19 then 0 else frame_id % 5 end as frame_id, case when event_id % 20 < 10 then 'kis' else 'trake' end as task, event_id // 20 % 30 as candidate from kf), so as (select * from (select *, row_number() over (partition by query_id, lower(video_id), frame_id order by seq) as r from se) where r = 1), st as (select * from (select *, row_number() over (partition by query_id, lower(video_id), frame_id, case when task = 'trake' then candidate else 0 end order by seq) as r from se) where r = 1)"


@query(ctes("kf") + _SEL + ", p as (select *, row_number() over (partition by query_id order by seq) as place from st) select query_id, task, video_id, frame_id, place from p where task = 'trake' or place <= 10")
def selection_tray(spark, d):
    return ss.selection_tray(_selection(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(ctes("kf") + _SEL + """, p as (select *, row_number() over (partition by query_id order by seq) as place from st), c as (select query_id, any_value(task) as task, count(*) as n_frames from p where (task = 'trake' or place <= 10) and place <= query_id + 1 group by 1)
select query_id, n_frames, case when task = 'trake' then null when n_frames > 5 then 'too many' when n_frames > 3 then 'many' when n_frames > 1 then 'fine' else 'best' end as band from c""")
def selection_band(spark, d):
    return ss.selection_band(ss.selection_tray(_selection(spark, d)).where("place <= query_id + 1"))


@query(ctes("kf") + _SEL + " select query_id, row_number() over (partition by query_id order by seq) as line_no, video_id||','||cast(frame_id as varchar) as line from so")
def kis_rows(spark, d):
    return ss.kis_rows(_selection(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))


@query(ctes("kf") + _SEL + """, a as (select query_id, seq, video_id, frame_id, unnest(case seq % 4 when 0 then ['a"1', 'b'] when 1 then ['A"1'] else ['c'] end) as answer, unnest(case seq % 4 when 0 then [0, 1] else [0] end) as i from se),
l as (select query_id, lower(video_id) as v, frame_id, lower(answer) as w, min(seq*10+i) as o, arg_min(video_id||','||cast(frame_id as varchar)||',"'||replace(answer, '"', '""')||'"', seq*10+i) as line from a group by all) select query_id, row_number() over (partition by query_id order by o) as line_no, line from l""")
def qa_rows(spark, d):
    """Frames' own answers, with capitals or without, or nothing but marks; else the common one."""
    own = F.when(F.col("seq") % 4 == 0, 'a"1 | b;').when(F.col("seq") % 4 == 1, 'A"1').when(F.col("seq") % 4 == 2, " ; ")
    return ss.qa_rows(_selection(spark, d).withColumn("answers", own).withColumn("common", F.lit("c"))).withColumn("line_no", F.col("line_no").cast("long"))


@query(ctes("kf") + _SEL + """, t as (select event_id as seq, seconds from kf), a as (select query_id, seq, video_id, frame_id, case when seq % 5 = 0 then seq*3 when seq % 5 = 1 then floor(seconds*1000+0.5)::bigint else frame_id*40 end as ms, unnest(case when seq % 4 = 0 then ['a', 'b'] else ['c'] end) as answer, unnest(case when seq % 4 = 0 then [0, 1] else [0] end) as i from se join t using (seq))
select query_id, row_number() over (partition by query_id order by seq, i) as place, case when query_id = 5 then answer else answer||'-'||video_id||'-'||ms::varchar end as text from a""")
def qa_payload(spark, d):
    """Times by timestamp, by seconds or by number; one query has no frames."""
    q = F.col("seq") % 5
    s = _selection(spark, d).join(fx.keyframes(spark, d).select(F.col("event_id").alias("seq"), "seconds"), "seq").withColumn("seconds", F.when(q == 1, F.col("seconds")).otherwise(0.0))
    s = s.withColumn("timestamp_ms", F.when(q == 0, F.col("seq") * 3)).withColumn("answers", F.when(F.col("seq") % 4 == 0, "a|b")).withColumn("common", F.lit("c"))
    s = s.withColumn("video_id", F.when(F.col("query_id") != 5, F.concat(F.lit("x/"), "video_id")))
    return ss.qa_payload(s).withColumn("place", F.col("place").cast("long"))


@query(ctes("kf") + _SEL + ", g as (select query_id, candidate, arg_min(video_id, seq) as v, string_agg(distinct cast(frame_id as varchar), ',' order by cast(frame_id as varchar)) filter (frame_id > 0) as f from se group by all) select query_id, row_number() over (partition by query_id order by candidate) as line_no, v||','||f as line from g where f is not null union all select query_id, row_number() over (partition by query_id order by seq), video_id||','||cast(frame_id as varchar) from so where query_id = 19")
def trake_rows(spark, d):
    return ss.trake_rows(_selection(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))


@query(ctes("kf") + _SEL + " select seq, dense_rank() over (partition by query_id order by candidate) as candidate from se where candidate <> 3")
def renumber_candidates(spark, d):
    return ss.renumber(_selection(spark, d).where("candidate != 3")).select("seq", F.col("candidate").cast("long").alias("candidate"))


@query("select doc_id, case when doc_id%3=0 then 'trake' when doc_id%3=1 then 'qa' else 'kis' end as task from documents")
def infer_task_type(spark, d):
    n = F.concat(F.lit("query-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "-TRAKE").when(F.col("doc_id") % 3 == 1, "-vqa").otherwise("-kis"), F.lit(".txt"))
    return fx.docs(spark, d).select("doc_id", ss.task_type(n).alias("task"))


@query(ctes("kf") + " select event_id, greatest(cast(round(seconds*1000) as bigint)-2500, 0) as start_ms, cast(round(seconds*1000) as bigint)+2500 as end_ms from kf")
def submission_window(spark, d):
    k = fx.keyframes(spark, d).withColumn("timestamp_ms", F.round(F.col("seconds") * 1000).cast("long"))
    return ss.submission_window(k).select("event_id", "start_ms", "end_ms")


@query(ctes("kf") + _SEL + " select query_id, count(*) as n_lines from so group by 1")
def submission_status(spark, d):
    return ss.submission_status(ss.kis_rows(_selection(spark, d)))


_MRR = _LEX + _TIER + ", g as (select doc_id+1 as frame_id, source as video_id from documents join labels using (doc_id) where quality = 1), f as (select query_id, coalesce(round(1.0::double/min(case when g.frame_id is not null then rank end), 6), 0) as rr from tr left join g using (video_id, frame_id) where rank <= 1000 group by 1), a as (select query_id, coalesce(rr, 0) as rr from (select query_id from qx union all select -query_id - 1 from qx) left join f using (query_id))"


def _ranks(spark, d):
    """Every query, and as many that find nothing."""
    q = fx.queries(spark, d)
    good = fx.docs(spark, d).join(fx.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return ss.reciprocal_ranks(se.search_text(q, fx.docs(spark, d), STOP), good, q.select("query_id").unionByName(q.select((-F.col("query_id") - 1).alias("query_id"))))


@query(_MRR + " select * from a")
def mrr(spark, d):
    return _ranks(spark, d)


@query(_MRR + " select round(avg(rr), 6) as mrr, count(*) as n_queries from a")
def mrr_mean(spark, d):
    return ss.mean_reciprocal_rank(_ranks(spark, d))


@query(ctes("kf") + " select event_id, round(greatest(0.0::double, 50+50*(1-value/300.0::double)-10*(event_id%4)), 6) as score from kf")
def contest_score(spark, d):
    return fx.keyframes(spark, d).select("event_id", F.round(ss.contest_score(F.col("value"), F.lit(300.0), F.col("event_id") % 4), 6).alias("score"))


@query("select doc_id from documents where source = 'src3'")
def scope_to_video(spark, d):
    """One video of a table laid out by video."""
    table = write_by_video(fx.docs(spark, d).select("video_id", "doc_id"), scratch(spark, "docs"), F.lit("all"), 16)
    return table.scoped(spark.createDataFrame([("src3",)], "video_id string")).select("doc_id")
