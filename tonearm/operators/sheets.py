"""Texts about discs and tags: TOC files, look-up answers in XML, text and JSON, gain tags, and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.discs import frames_of, timestamp

#: ID3v2 text frames and the fields of a track they hold.
FRAME_FIELDS = {
    "TIT2": "track_name", "TT2": "track_name", "TALB": "album_name", "TAL": "album_name", "TPE1": "artist_name", "TP1": "artist_name", "TPE2": "performer_name", "TP2": "performer_name",
    "TCOM": "composer_name", "TCM": "composer_name", "TPE3": "conductor_name", "TP3": "conductor_name", "TRCK": "track_number", "TRK": "track_number", "TPOS": "album_number", "TPA": "album_number",
    "TMED": "media", "TMT": "media", "TSRC": "isrc", "TRC": "isrc", "TCOP": "copyright", "TCR": "copyright", "TPUB": "publisher", "TPB": "publisher", "TYER": "year", "TYE": "year", "TDRC": "date", "TRD": "date", "COMM": "comment", "COM": "comment", "TCMP": "compilation",
}
#: Keys of Vorbis comments that mean the same.
ALIASES = {"TOTALTRACKS": "TRACKTOTAL", "TOTALDISCS": "DISCTOTAL", "ALBUMARTIST": "ALBUM ARTIST", "PERFORMER": "ALBUM ARTIST"}


def sheet_kind(text: Column) -> Column:
    """A sheet that starts its disc with CD_DA is a TOC file, any other a cue sheet."""
    return F.when(F.contains(text, F.lit("CD_DA")), "toc").otherwise("cue")


def toc_text(starts: DataFrame) -> DataFrame:
    """sheet_id and toc: a TOC file of (sheet_id, track_number, start)."""
    line = F.concat(F.lit("// track "), F.col("track_number").cast("string"), F.lit("\nTRACK AUDIO\nSTART "), timestamp(F.col("start")))
    rows = starts.filter("start is not null").select("sheet_id", F.struct("track_number", line.alias("line")).alias("x"))
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]))
    return rows.groupBy("sheet_id").agg(F.concat(F.lit("CD_DA\n"), body).alias("toc"))


def parse_toc(texts: DataFrame) -> DataFrame:
    """sheet_id, track_number (by order) and start of TOC files (sheet_id, toc)."""
    lines = texts.select("sheet_id", F.posexplode(F.split("toc", "\r?\n")).alias("pos", "line"))
    stamp = F.regexp_extract("line", r"^START (\d+:\d+:\d+)", 1)
    told = lines.withColumn("n", F.count_if(F.col("line").startswith("TRACK ")).over(Window.partitionBy("sheet_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return told.filter(stamp != "").select("sheet_id", F.col("n").cast("int").alias("ordinal"), frames_of(stamp).alias("start"))


def xml_escaped(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def answers_xml(tracks: DataFrame) -> DataFrame:
    """sheet_id and answer: an XML answer with the titles of (sheet_id, track_number, title), as look-up services give."""
    one = F.concat(F.lit("<track><position>"), F.col("track_number").cast("string"), F.lit("</position><title>"), xml_escaped(F.coalesce("title", F.lit(""))), F.lit("</title></track>"))
    rows = tracks.select("sheet_id", F.struct("track_number", one.alias("x")).alias("t"))
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]))
    return rows.groupBy("sheet_id").agg(F.concat(F.lit("<metadata><list>"), body, F.lit("</list></metadata>")).alias("answer"))


def parse_xml(answers: DataFrame) -> DataFrame:
    """sheet_id, track_number and title. An empty title has no text node, so titles are taken track by track."""
    each = answers.select("sheet_id", F.explode(F.sequence(F.lit(1), F.greatest(F.xpath_int("answer", F.lit("count(/metadata/list/track)")), F.lit(1)))).alias("k"), "answer")
    part = F.regexp_extract_all("answer", F.lit("(?s)(<track>.*?</track>)"), F.lit(1))[F.col("k") - 1]
    return each.select("sheet_id", F.xpath_int(part, F.lit("/track/position")).alias("track_number"), F.xpath_string(part, F.lit("/track/title")).alias("title"))


def xmcd_text(discs: DataFrame, tracks: DataFrame) -> DataFrame:
    """sheet_id and xmcd: a disc as lines KEY=value; ``discs`` has (sheet_id, artist, album), ``tracks`` the titles."""
    line = F.concat(F.lit("TTITLE"), (F.col("track_number") - 1).cast("string"), F.lit("="), F.coalesce("title", F.lit("")))
    lines = tracks.groupBy("sheet_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("track_number", line.alias("l")))), lambda x: x["l"])).alias("body"))
    return discs.join(lines, "sheet_id").select("sheet_id", F.concat(F.lit("# xmcd\nDTITLE="), "artist", F.lit(" / "), "album", F.lit("\n"), "body").alias("xmcd"))


def parse_xmcd(texts: DataFrame) -> DataFrame:
    """sheet_id, artist, album, track_number and title."""
    lines = texts.select("sheet_id", F.explode(F.split("xmcd", "\r?\n")).alias("line"), F.regexp_extract("xmcd", r"(?m)^DTITLE=(.*)$", 1).alias("d"))
    named = F.split("d", " / ", 2)
    found = lines.filter(F.col("line").rlike(r"^TTITLE\d+="))
    return found.select("sheet_id", named[0].alias("artist"), F.try_element_at(named, F.lit(2)).alias("album"), (F.regexp_extract("line", r"^TTITLE(\d+)=", 1).cast("int") + 1).alias("track_number"), F.regexp_extract("line", r"^TTITLE\d+=(.*)$", 1).alias("title"))


def gain_text(gain: Column) -> Column:
    return F.concat(F.format_string("%.2f", gain), F.lit(" dB"))


def gain_of(text: Column) -> Column:
    return F.regexp_replace(text, " dB$", "").try_cast("double")


def sync_safe(n: Column) -> Column:
    """A number below 2^28 in four bytes of seven bits, as one whole number."""
    part = lambda s: F.shiftleft(F.shiftright(n, 7 * s).bitwiseAND(F.lit(127).cast("bigint")), 8 * s)
    return part(0) + part(1) + part(2) + part(3)


def from_sync_safe(n: Column) -> Column:
    part = lambda s: F.shiftleft(F.shiftright(n, 8 * s).bitwiseAND(F.lit(127).cast("bigint")), 7 * s)
    return part(0) + part(1) + part(2) + part(3)
