"""Exports: CSV of candidates, deletions and manifests, and DFXML reports."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeway.functions.names import csv_field, iso_utc

#: Files of a DFXML report that is one text, made on the driver.
MAX_REPORT = 100_000
NAMESPACE = "http://www.forensicswiki.org/wiki/Category:Digital_Forensics_XML"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


#: Header and columns of the three kinds of CSV.
CANDIDATE_COLUMNS = {
    "source": _text, "name": _text, "original_folder": _text, "size": _text, "modified_utc": lambda _: iso_utc(F.col("modified")), "deleted_utc": lambda _: iso_utc(F.col("deleted_at")),
    "grade": _text, "percent_intact": _text, "is_directory": lambda _: _text("is_dir"), "detail": _text,
}
DELETION_COLUMNS = {
    "deleted_utc": lambda _: iso_utc(F.col("deleted_at")), "name": _text, "parent_path": _text, "size": _text, "is_directory": lambda _: _text("is_dir"), "kind": _text,
    "record_no": _text, "sequence": _text, "usn": _text,
}
MANIFEST_COLUMNS = {"original_path": _text, "recovered_path": _text, "size": lambda _: _text("bytes"), "sha256": _text, "grade": lambda _: _text("final_grade"), "source": _text, "error": _text}


def csv_lines(df: DataFrame, columns: dict) -> DataFrame:
    """One column ``line``: the rows as CSV."""
    return df.select(F.concat_ws(",", *[csv_field(make(name)) for name, make in columns.items()]).alias("line"))


def header_line(columns: dict) -> str:
    return ",".join(columns)


def write_csv(df: DataFrame, columns: dict, path: str, mode: str = "overwrite") -> None:
    """The rows as CSV part files, each with its header, LF between lines."""
    named = df.select(*[make(name).alias(name) for name, make in columns.items()])
    named.write.mode(mode).option("header", True).option("lineSep", "\n").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_manifest(recovered: DataFrame, path: str) -> None:
    """Adds recovered files to a manifest: part files without headers, and the header once, in a file that sorts before them."""
    spark = recovered.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    head = hadoop(f"{path}/0-header.csv")
    files = head.getFileSystem(spark._jsc.hadoopConfiguration())
    csv_lines(recovered, MANIFEST_COLUMNS).write.mode("append").text(path)
    if not files.exists(head):
        out = files.create(head)
        out.write(bytearray(f"{header_line(MANIFEST_COLUMNS)}\n".encode()))
        out.close()


def _sub(parent: ET.Element, tag: str, text: object = None, **attributes: object) -> ET.Element:
    e = ET.SubElement(parent, tag, {k: str(v) for k, v in attributes.items()})
    e.text = None if text is None else str(text)
    return e


def _iso(d: datetime) -> str:
    return d.strftime("%Y-%m-%dT%H:%M:%SZ")


def _report(volume: str, started: datetime, finished: datetime, program: str, version: str) -> ET.Element:
    """A report without its files."""
    top = ET.Element("dfxml", {"xmlns": NAMESPACE, "version": "1.2.0"})
    _sub(_sub(top, "metadata"), "type", "recovery")
    creator = _sub(top, "creator")
    _sub(creator, "program", program)
    _sub(creator, "version", version)
    environment = _sub(creator, "execution_environment")
    _sub(environment, "os_sysname", "Windows")
    _sub(environment, "start_time", _iso(started))
    _sub(environment, "end_time", _iso(finished))
    _sub(_sub(top, "source"), "image_filename", volume)
    return top


def _file_object(r: dict, o: ET.Element) -> ET.Element:
    """Element ``o`` with what is known of one recovered file."""
    _sub(o, "filename", r["original_path"])
    _sub(o, "filesize", r["bytes"])
    _sub(o, "name_type", "d" if r.get("is_dir") else "r")
    _sub(o, "alloc", 0)
    for tag, key in (("mtime", "modified"), ("dtime", "deleted_at")):
        if r.get(key):
            _sub(o, tag, _iso(r[key]))
    runs = _sub(o, "byte_runs")
    for run in r.get("runs") or []:
        place = {"img_offset": run["img_offset"]} if run["img_offset"] >= 0 else {}
        _sub(runs, "byte_run", file_offset=run["file_offset"], len=run["len"], **place)
    if r.get("sha256"):
        _sub(o, "hashdigest", r["sha256"], type="sha256")
    how = _sub(o, "recovery")
    _sub(how, "source", r["source"])
    _sub(how, "grade", r["final_grade"])
    _sub(how, "recovered_path", r["recovered_path"])
    if r.get("error"):
        _sub(how, "error", r["error"])
    return o


def dfxml(recovered: DataFrame, volume: str, started: datetime, finished: datetime, program: str = "sedgeway", version: str = "0.1.0") -> str:
    """A DFXML 1.2 report of a session as one text, an object for each recovered file. More than MAX_REPORT files are refused; ``write_dfxml`` takes any number."""
    rows = recovered.limit(MAX_REPORT + 1).collect()
    if len(rows) > MAX_REPORT:
        raise ValueError(f"more than {MAX_REPORT} files; use write_dfxml")
    top = _report(volume, started, finished, program, version)
    for r in rows:
        _file_object(r.asDict(recursive=True), _sub(top, "fileobject"))
    ET.indent(top)
    return ET.tostring(top, encoding="unicode", xml_declaration=True)


def dfxml_objects(recovered: DataFrame) -> DataFrame:
    """(value): the report's element of each recovered file, made where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ET.tostring(_file_object(r, ET.Element("fileobject")), encoding="unicode") for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    return recovered.mapInArrow(run, "value string")


def write_dfxml(recovered: DataFrame, path: str, volume: str, started: datetime, finished: datetime, program: str = "sedgeway", version: str = "0.1.0") -> None:
    """The report of any number of files as a folder: its files one after another, in the order of their names, are one document.

    Tasks write the elements; the head and the tail stand in files of their own before and after them. An existing folder is an error.
    """
    spark = recovered.sparkSession
    whole = ET.tostring(_report(volume, started, finished, program, version), encoding="unicode", xml_declaration=True)
    cut = whole.rindex("</dfxml>")
    dfxml_objects(recovered).write.mode("error").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name, text in (("0-head.xml", whole[:cut] + "\n"), ("z-tail.xml", whole[cut:] + "\n")):
        at = hadoop(f"{path}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(text.encode()))
        out.close()


def byte_runs(candidates: DataFrame, cluster: int = 4096) -> DataFrame:
    """``candidates`` with ``runs`` as byte ranges in file and image (-1: sparse)."""
    return candidates.withColumn(
        "runs",
        F.transform(
            "runs",
            lambda r: F.struct(
                (r["vcn"] * cluster).alias("file_offset"), (r["clusters"] * cluster).alias("len"), F.when(r["lcn"] < 0, -1).otherwise(r["lcn"] * cluster).cast("long").alias("img_offset")
            ),
        ),
    )
