"""Small change logs for tests, and their meaning worked out in plain Python."""

from pyspark.sql import types as T

from tidemark.entities import SEQ, Entity

END = 253402300799999  # 9999-12-31 23:59:59.999 UTC, epoch ms


def record(entity: Entity, key: int, ts: int | None, seq: int, op: str = "u", **values) -> dict:
    row = dict.fromkeys(entity.columns)
    row.update({entity.key: key, "cdc_source_ts_ms": ts, "cdc_op": op, "cdc_deleted": op == "d"})
    return {**row, **values, SEQ: seq}


def log(spark, entity: Entity, rows: list[dict]):
    schema = T.StructType([*entity.wire_schema, T.StructField(SEQ, T.LongType())])
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def last_versions(entity: Entity, rows: list[dict]) -> dict[int, dict]:
    found: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r["cdc_source_ts_ms"], r[SEQ])):
        found[r[entity.key]] = r
    return found


def intervals(entity: Entity, rows: list[dict]) -> set[tuple]:
    """(key, start, seq-order position is implied, end) of each version."""
    out = []
    by_key: dict[int, list[dict]] = {}
    for r in rows:
        by_key.setdefault(r[entity.key], []).append(r)
    for key, versions in by_key.items():
        versions.sort(key=lambda r: (r["cdc_source_ts_ms"], r[SEQ]))
        starts = [v["cdc_source_ts_ms"] for v in versions]
        for v, end in zip(versions, [*starts[1:], END], strict=True):
            out.append((key, v["cdc_source_ts_ms"], v["updated_by"], end))
    return sorted(out)
