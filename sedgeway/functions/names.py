"""Column functions on file names, sizes and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each category; an extension in two lists belongs to the later one in BUILD_ORDER. Fixed values.
EXTENSIONS = {
    "Document": "pdf doc docx xls xlsx xlsm ppt pptx odt ods odp rtf txt md csv epub pages numbers key one tex log".split(),
    "Image": "jpg jpeg png gif bmp tif tiff webp heic heif avif svg ico raw cr2 cr3 nef arw dng psd ai xcf".split(),
    "Video": "mp4 mkv avi mov wmv webm m4v mpg mpeg flv 3gp mts m2ts vob".split(),
    "Audio": "mp3 flac wav aac m4a ogg opus wma aiff aif mid midi alac".split(),
    "Archive": "zip 7z rar tar gz tgz bz2 xz zst iso cab lz lzma wim vhd vhdx".split(),
    "App": "exe msi bat cmd ps1 com scr lnk appx msix appxbundle msixbundle jar apk".split(),
    "Code": (
        "cs c cpp cc h hpp py js mjs ts tsx jsx java go rs rb php swift kt sql sh json xml yaml yml toml html htm css scss vue xaml csproj sln lua dart"
    ).split(),
}
BUILD_ORDER = ("Code", "Document", "Image", "Video", "Audio", "Archive", "App")
CATEGORIES = ("Other", "Folder", "Document", "Image", "Video", "Audio", "Archive", "App", "Code")
#: Names by which a query may call a category. Fixed values.
ALIASES = {
    "Document": "doc docs document documents",
    "Image": "image images pic pics picture pictures photo photos",
    "Video": "video videos movie movies",
    "Audio": "audio music sound",
    "Archive": "archive archives zip compressed",
    "App": "app apps exe program programs",
    "Code": "code source",
    "Folder": "folder folders dir",
    "Other": "other",
}
CATEGORY_OF_ALIAS = {a: c for c, names in ALIASES.items() for a in names.split()}
CATEGORY_OF_EXTENSION = {e: c for c in BUILD_ORDER for e in EXTENSIONS[c]}


def fold(name: Column) -> Column:
    """Lower case, position by position: a letter whose lower case is longer keeps its place as it is."""
    low = F.lower(name)
    return F.when(F.length(low) == F.length(name), low).otherwise(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def extension(folded: Column) -> Column:
    """Text after the last dot; empty without one, or if it is the first or last character."""
    return F.regexp_extract(folded, r"(?s)^.+\.([^.]+)$", 1)


def category(folded: Column, is_dir: Column) -> Column:
    ext = extension(folded)
    by_list = reduce(lambda acc, c: acc.when(ext.isin([e for e, k in CATEGORY_OF_EXTENSION.items() if k == c]), F.lit(c)), BUILD_ORDER, F.when(is_dir, F.lit("Folder")))
    return by_list.otherwise(F.lit("Other"))


def category_rank(cat: Column) -> Column:
    """Place of a category in the fixed order."""
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), cat)


def size_text(size: Column) -> Column:
    """``1.5 KB``: one decimal under 100 of a unit, none from there on; a dash for unknown sizes."""
    units = ["KB", "MB", "GB", "TB", "PB"]
    out = F.when(size < 0, F.lit("—")).when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, u in enumerate(units):
        v = size / F.lit(float(1024 ** (i + 1)))
        text = F.concat(F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v)), F.lit(f" {u}"))
        out = out.when(size < 1024 ** (i + 2), text) if i < len(units) - 1 else out.otherwise(text)
    return out


def age_text(modified: Column, now: Column) -> Column:
    """How long ago, to the minute, hour or day within a week; the date otherwise."""
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))
    day = F.date_format(modified, "yyyy-MM-dd")
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(modified.isNull(), "—").when(s < 0, day).when(s < 60, "just now").when(s < 3600, ago(60, "min"))
        .when(s < 86400, ago(3600, "h")).when(s < 7 * 86400, ago(86400, "d")).otherwise(day)
    )


def safe_file_name(name: Column) -> Column:
    """A name with forbidden characters as ``_`` and without blanks around it; ``unnamed`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f"<>|:*?\\/]', "_"), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unnamed"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def dot_extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]+)$", 1)


def restore_name(name: Column, created: Column) -> Column:
    """``stem (from yyyy-MM-dd HHmm).ext`` for a version taken at ``created``."""
    return F.concat(stem(name), F.lit(" (from "), F.date_format(created, "yyyy-MM-dd HHmm"), F.lit(")"), dot_extension(name))


def carved_name(type_id: Column, lcn: Column, ext: Column) -> Column:
    return F.concat(type_id, F.lit("_"), lcn.cast("string"), ext)


def csv_field(value: Column) -> Column:
    """A CSV field, quoted where it holds a comma, quote or line break."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def iso_utc(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def is_recycled_name(name: Column) -> Column:
    """``$R``, six ASCII letters or digits, then nothing or a dot."""
    return name.rlike(r"^\$R[A-Za-z0-9]{6}(\.|$)")


def is_delete_marker(name: Column, record_no: Column) -> Column:
    """16 or 24 hexadecimal digits (up to a colon), of which the first 16 hold the record's own number."""
    head = F.substring_index(name, ":", 1)
    shape = head.rlike(r"^([0-9A-Fa-f]{16}|[0-9A-Fa-f]{24})$")
    return F.when(shape, F.conv(F.substring(head, 5, 12), 16, 10).cast("long") == record_no).otherwise(F.lit(False))


#: What nobody wants back from a list of deleted files. Fixed values.
NOISE_EXTENSIONS = (".tmp", ".etl", ".log", ".part", ".crdownload", ".lock", ".pf")
NOISE_PARTS = (
    "\\AppData\\Local\\Temp\\", "\\$Recycle.Bin\\", "\\System Volume Information\\", "\\$Extend\\", "\\Cache\\", "\\Code Cache\\",
    "\\GPUCache\\", "\\INetCache\\", "\\WebCache\\", "\\Temp\\",
)


def is_noise(name: Column, parent_path: Column, is_dir: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^.\\]*)$", 1))
    folder = F.lower(F.coalesce(F.when(parent_path.endswith("\\"), parent_path).otherwise(F.concat(parent_path, F.lit("\\"))), F.lit("\\")))
    inside = reduce(lambda a, p: a | F.contains(folder, F.lit(p.lower())), NOISE_PARTS, F.lit(False))
    return ~is_dir & (name.startswith("~$") | ext.isin(*NOISE_EXTENSIONS) | inside)


def text_filter(name: Column, folder: Column, text: str) -> Column:
    """Rows of a recovery list whose name or folder holds ``text``, in either case."""
    t = F.lit(text.lower())
    return F.contains(F.lower(name), t) | F.contains(F.lower(F.coalesce(folder, F.lit(""))), t)


def snippet(head: Column, most: int = 200) -> Column:
    """Printable text of a file's first bytes: control words of rich text and braces left out, line ends as one blank."""
    text = F.decode(F.substring(head, 1, 65536), "ISO-8859-1")
    plain = F.regexp_replace(text, r"\\(?:[\p{L}\p{N}-]|\\)*(?: |(?=[^\p{L}\p{N}\\-])|$)", "")
    one_line = F.regexp_replace(F.regexp_replace(plain, r"[{}]", ""), r"[\r\n]+", "\n")
    shown = F.regexp_replace(F.regexp_replace(one_line, r"[^ -~\n]", ""), r"(?<=[ ])\n+|^\n+", "")
    return F.trim(F.substring(F.translate(F.regexp_replace(shown, r"\n+", "\n"), "\n", " "), 1, most))


def progress_text(done: Column, total: Column, seconds: Column) -> Column:
    """``12.4 GB of 410 GB · ETA 6 min`` from bytes done, bytes in all and the seconds that took; no ETA before the first second."""
    left = F.when((done > 0) & (seconds >= 1), (total - done) * seconds / done)
    eta = F.when(left >= 60, F.concat(F.lit(" · ETA "), F.ceil(left / 60).cast("string"), F.lit(" min"))).when(left > 0, F.lit(" · almost done")).otherwise(F.lit(""))
    return F.concat(size_text(done), F.lit(" of "), size_text(total), eta)


#: Text of a candidate's grade, {p} being its intact share. Fixed values.
GRADE_TEXT = {
    "Excellent": "All data still on disk.",
    "Good": "All data appears intact, but it could not be fully verified.",
    "Partial": "Some of this file's space has been reused by other files. About {p}% is still intact.",
    "Overwritten": "Every part of this file's space has been reused by other files.",
    "Zeroed": "On SSDs, Windows tells the drive to discard deleted data within seconds. If a file shows Zeroed, no copy of it exists on this drive.",
    "Encrypted": "This file was encrypted with EFS and cannot be recovered.",
}


def grade_chip(grade: Column, percent: Column, detail: Column) -> Column:
    """(text, tooltip) of a grade."""
    p = percent.cast("string")
    text = F.when(grade == "Partial", F.concat(F.lit("Partially overwritten ("), p, F.lit("%)"))).otherwise(F.when(grade.isin(*GRADE_TEXT), grade).otherwise("Unknown"))
    tip = F.when(F.lit(False), "")
    for g, t in GRADE_TEXT.items():
        tip = tip.when(grade == g, F.replace(F.lit(t), F.lit("{p}"), p) if "{p}" in t else F.lit(t))
    tip = tip.otherwise(F.coalesce(detail, F.lit("It could not be determined whether this file's data is intact.")))
    return F.struct(text.alias("text"), tip.alias("tooltip"))


def log_chip(kind: Column, slot: Column) -> Column:
    """Text of a deletion in the log by its kind and the state of its record."""
    return F.when(kind == "Recycled", "In Recycle Bin").when(kind == "Replaced", "Replaced").when(slot == "Free", "Recoverable (slot intact)").when(slot == "Reused", "Record reused").otherwise("Checking…")
