"""Column functions on texts, names and numbers. Null stays null unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin() -> tuple[str, str]:
    """Latin letters whose compatibility form without marks is one other character, and those characters."""
    a, b = [], []
    for i in range(0xC0, 0x2100):
        c = chr(i)
        if i <= 0x24F or 0x1E00 <= i <= 0x1EFF:
            bare = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
            if len(bare) == 1 and bare != c:
                a.append(c)
                b.append(bare)
    return "".join(a), "".join(b)


_FROM, _TO = _latin()


def strip_accents(c: Column) -> Column:
    """Lower case without accents. A letter that does not decompose, as the Vietnamese d with stroke, stays."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"\p{M}", "")


def bare_words(c: Column) -> Column:
    """Distinct words (letters, digits, underscore) of a text that ``strip_accents`` has been through, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def word_tokens(c: Column) -> Column:
    """Distinct words (letters, digits, underscore) of the text without accents, in order of first appearance."""
    return bare_words(strip_accents(c))


def strip(c: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


# Words that recognisers of on-screen text misread, and what they stand for.
SPELLINGS = {
    "iuong": "lương", "ivong": "lương", "luong": "lương", "tuong": "thương", "thvong": "thương", "huong": "hưởng", "hvong": "hưởng", "huởng": "hưởng",
    "hvởng": "hưởng", "nguoi": "người", "nguòi": "người", "nguời": "người", "duong": "đường", "duờng": "đường", "dường": "đường", "cuong": "cường",
    "phuong": "phường", "chuong": "chương", "truong": "trường", "truờng": "trường", "vuon": "vươn", "duoc": "được",
}


def normalize_text(c: Column, spellings: dict[str, str] | None = None) -> Column:
    """One space for any white space, and whole words of ``spellings`` in any case put right: all capitals, a first one, or none stay so. Null is empty."""
    fixed = SPELLINGS if spellings is None else spellings
    clean = collapse_spaces(F.coalesce(c, F.lit("")))
    if not fixed:
        return clean
    table = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])

    def right(w):
        new = table[F.lower(w)]
        first = F.substring(w, 1, 1)
        capital = F.concat(F.upper(F.substring(new, 1, 1)), F.expr("''"), F.lower(F.substring(new, 2, 1000)))
        return F.when(new.isNull(), w).when(w == F.upper(w), F.upper(new)).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(new)

    parts = F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(parts, right), "")


def frame_order_key(c: Column) -> Column:
    """Natural order of frame names: numbers first, by value, then others by their text without case."""
    bare = canonical_frame_id(c)
    number = bare.rlike("^[0-9]+$")
    named = F.when(~number, F.struct(F.lower(bare).alias("name"), F.lower(strip(c)).alias("whole")))
    return F.struct((~number).alias("named"), F.when(number, bare.cast("decimal(38,0)")).alias("number"), named["name"].alias("name"), named["whole"].alias("whole"))


def video_and_frame(video: Column, frame: Column, source: Column, info: Column, path: Column) -> Column:
    """Struct of video and frame of a result as browsers hold it: its own fields, else what ``info`` ("video-time"), the image's address or path name.

    A name with a colon, or of the image folder or host, is none; without any, the video is "video" and the frame 0. A trailing .mp4 goes.
    """
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    bad = lambda x: F.contains(x, F.lit(":")) | (F.lower(x) == "keyframes") | F.contains(F.lower(x), F.lit("localhost"))
    name = lambda x: F.when(~bad(some(x)), some(x))
    number = lambda x: F.nullif(F.regexp_extract(x, r"keyframe_([0-9]+)\.", 1), F.lit("")).cast("long")
    own = F.expr("try_cast(null as bigint)") if frame is None else frame.try_cast("bigint")
    n = F.coalesce(F.when(own > 0, own), number(source), number(path), own, F.lit(0).cast("long"))
    first = name(F.split(info, "-")[0])
    folder = lambda x: name(F.regexp_extract(x, r"(?i)/([^/]+)/keyframes/keyframe_[0-9]+", 1))
    coded = lambda x: some(F.regexp_extract(x, r"(?i)(L[0-9]+_V[0-9]+)", 1))
    above = name(F.regexp_extract(source, r"(?i)/([^/]+)/keyframe_[0-9]+", 1))
    v = F.coalesce(name(video), F.when(F.lower(first) != "video", first), folder(source), coded(source), above, folder(path), coded(path), F.lit("video"))
    return F.struct(F.trim(F.regexp_replace(v, r"(?i)\.mp4$", "")).alias("video"), n.alias("frame"))


def display_score(rerank: Column, distance: Column, score: Column) -> Column:
    return F.coalesce(rerank, distance, score).cast("double")


def display_ms(timestamp_ms: Column, seconds: Column, frame: Column) -> Column:
    """Milliseconds to show: as stored, else from the seconds, else from the frame at 25 a second."""
    return F.coalesce(timestamp_ms.cast("long"), F.round(seconds * 1000.0).cast("long"), F.round(frame / 25.0 * 1000.0).cast("long"))


def text_quality(c: Column) -> Column:
    """0.65 * share of ordinary characters + 0.35 * min(1, length / 12); empty: 0."""
    valid = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}\s.,:;!?'\-_/()%+&]", ""))
    n = F.length(c)
    return F.when(n == 0, F.lit(0.0)).otherwise(0.65 * valid / n + 0.35 * F.least(F.lit(1.0), n / 12.0))


def format_hms(seconds: Column) -> Column:
    """HH:MM:SS.mmm of non-negative seconds (below 0: 0)."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h = F.floor(ms / 3600000)
    long_h = F.when(h < 100, two(h)).otherwise(h.cast("string"))
    return F.concat(long_h, F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def format_ms(seconds: Column) -> Column:
    """MM:SS."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)))
    m = F.floor(s / 60)
    return F.concat(F.when(m < 100, F.lpad(m.cast("string"), 2, "0")).otherwise(m.cast("string")), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def canonical_frame_id(c: Column) -> Column:
    """The number of a frame's name (with or without a prefix, leading zeros and a trailing .0) without leading zeros; a name that is no number stays as it is. Null is empty."""
    name = strip(F.coalesce(c, F.lit("")))
    digits = F.regexp_extract(name, r"(?i)^(?:frame[_-]?|keyframe[_-]?)?0*([0-9]+)(\.0+)?$", 1)
    return F.when(digits != "", digits).otherwise(name)


def file_stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def named_frame_id(path: Column) -> Column:
    """What follows "keyframe" in a file's name, else the name."""
    stem = file_stem(path)
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"(?i)keyframe[_-]?(.+)$", 1), F.lit("")), stem)


def parse_frame_id(path: Column) -> Column:
    """The number of a key frame's file name, null without one."""
    return F.nullif(F.regexp_extract(path, r"(?:keyframe|frame)?[_-]?([0-9]+)\.[A-Za-z0-9]+$", 1), F.lit("")).cast("long")


# How file names tell a time, in seconds, in milliseconds, in seconds with a point.
NAMED_SECONDS = r"(?i)(?:^|[_-])ts[_-]?(\d+(?:\.\d+)?)s?(?:[_-]|$)"
NAMED_MILLISECONDS = r"(?i)(?:^|[_-])(\d+(?:\.\d+)?)ms(?:[_-]|$)"
NAMED_POINT = r"(?:^|[_-])(\d+\.\d+)(?:[_-]|$)"


def timestamp_from_name(path: Column) -> Column:
    """Seconds from a file name, by parts between its start, underscores, hyphens and its end: ts_12.5s, else 1500ms, else 12.5 (with a point), else null."""
    stem = file_stem(path)
    part = lambda p: F.nullif(F.regexp_extract(stem, p, 1), F.lit("")).cast("double")
    return F.coalesce(part(NAMED_SECONDS), part(NAMED_MILLISECONDS) / 1000, part(NAMED_POINT))


def doc_key(video: Column, frame: Column) -> Column:
    return F.concat(video, F.lit("/keyframes/keyframe_"), frame.cast("string"), F.lit(".webp"))


def key_video(key: Column) -> Column:
    """The video of a key: the folder before keyframes, without a batch's folder."""
    return F.element_at(F.split(F.regexp_extract(key, r"^(.*?)/keyframes/", 1), "/"), -1)


def key_frame(key: Column) -> Column:
    return F.nullif(F.regexp_extract(F.element_at(F.split(key, "/"), -1), r"([0-9]+)", 1), F.lit("")).cast("long")


# Fixed value: the letters with marks that tell Vietnamese.
VIETNAMESE = "[àáãạảăắằẳẵặâấầẩẫậèéẹẻẽêềếểễệđìíĩỉịòóõọỏôốồổỗộơớờởỡợùúũụủưứừửữựỳýỹỷỵ]"


def is_vietnamese(c: Column) -> Column:
    """Has a letter with a mark that Vietnamese uses."""
    return F.lower(c).rlike(VIETNAMESE)


def plain_video(c: Column) -> Column:
    """A video's name without .mp4 and outer white space."""
    return strip(F.regexp_replace(c, r"(?i)\.mp4\s*$", ""))
