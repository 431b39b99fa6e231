"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _B, _I, _N = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VOLUMES = _schema(volume_id=_S, drive_letter=_S, root=_S, mode=_S, format=_S, serial=_L, journal_id=_L, next_usn=_L, total_size=_L, free_space=_L, removable=_B)
ENTRIES = _schema(
    volume_id=_S, entry_id=_L, parent_id=_L, name=_S, is_dir=_B, hidden=_B, system=_B, reparse=_B, deleted=_B, metadata_known=_B, size=_L, modified=_N, record_no=_L
)
JOURNAL = _schema(volume_id=_S, usn=_L, ts=_N, record_no=_L, sequence=_I, parent_record_no=_L, reason=_L, attributes=_L, name=_S)
DELETIONS = _schema(
    volume_id=_S, record_no=_L, sequence=_I, parent_record_no=_L, name=_S, parent_path=_S, size=_L, is_dir=_B, modified=_N, deleted_at=_N, kind=_S, usn=_L
)
RUNS = T.ArrayType(_schema(vcn=_L, lcn=_L, clusters=_L))
MFT_RECORDS = _schema(
    volume_id=_S, record_no=_L, sequence=_I, in_use=_B, is_dir=_B, base_record=_L, parent_record=_L, parent_sequence=_I, name=_S, real_size=_L, initialized_size=_L,
    allocated_size=_L, data_flags=_I, compression_unit=_I, resident=_B, resident_data=T.BinaryType(), runs=RUNS, created=_N, modified=_N,
)
CANDIDATES = _schema(source=_S, name=_S, original_folder=_S, size=_L, modified=_N, deleted_at=_N, grade=_S, percent_intact=_I, is_dir=_B, detail=_S)
CARVED = _schema(type_id=_S, label=_S, category=_S, start_lcn=_L, size=_L, info=_S, suggested_name=_S)

#: Journal reason bits. Fixed values.
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION = 0x1, 0x2, 0x4
FILE_CREATE, FILE_DELETE = 0x100, 0x200
RENAME_OLD_NAME, RENAME_NEW_NAME = 0x1000, 0x2000
BASIC_INFO_CHANGE = 0x8000
CLOSE = 0x80000000
#: File attribute bits. Fixed values.
ATTR_HIDDEN, ATTR_SYSTEM, ATTR_DIRECTORY, ATTR_REPARSE = 0x2, 0x4, 0x10, 0x400
