"""Requests and responses of the engine, and what they are made of; all can be read from dicts (YAML)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

ENGINES = ("spark", "flink")
APPEND, RETRACT, CORRECT_FROM, CORRECT_TO = 0, 1, 2, 3
#: Changelog kinds by operation code.
KINDS = {APPEND: "+I", RETRACT: "-D", CORRECT_FROM: "-U", CORRECT_TO: "+U"}


class InvalidQueryError(ValueError):
    """The request's query can't be run."""


def to_time(x: Any) -> datetime | None:
    """A UTC time without zone, from text or a time."""
    if x is None or x == "":
        return None
    t = x if isinstance(x, datetime) else datetime.fromisoformat(str(x).replace("Z", "+00:00"))
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


@dataclass
class Vocab:
    offset: str = "offset"
    op: str = "op"
    system_time: str = "system_time"
    event_time: str = "event_time"

    @staticmethod
    def of(d: dict | None) -> Vocab:
        d = d or {}
        return Vocab(d.get("offsetColumn", "offset"), d.get("operationTypeColumn", "op"), d.get("systemTimeColumn", "system_time"), d.get("eventTimeColumn", "event_time"))


@dataclass
class Step:
    query: str
    alias: str | None = None


@dataclass
class Input:
    alias: str
    paths: list[str]
    schema_file: str | None = None
    interval: tuple[int, int] | None = None
    watermarks: list[datetime] = field(default_factory=list)
    vocab: Vocab = field(default_factory=Vocab)
    dataset_id: str = ""

    @staticmethod
    def of(d: dict) -> Input:
        i = d.get("offsetInterval")
        marks = [to_time(w["eventTime"]) for w in d.get("explicitWatermarks") or []]
        return Input(d.get("queryAlias") or d["datasetAlias"], list(d.get("dataPaths") or []), d.get("schemaFile"), (i["start"], i["end"]) if i else None, marks, Vocab.of(d.get("vocab")), d.get("datasetId", ""))


@dataclass
class Transform:
    steps: list[Step]
    engine: str = "spark"
    temporal: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def of(d: dict) -> Transform:
        steps = [Step(q["query"], q.get("alias")) for q in d.get("queries") or []] or [Step(d["query"])]
        return Transform(steps, d.get("engine", "spark"), {t["name"]: list(t.get("primaryKey") or []) for t in d.get("temporalTables") or []})


@dataclass
class TransformRequest:
    transform: Transform
    inputs: list[Input]
    system_time: datetime
    next_offset: int
    data_path: str
    checkpoint: str
    prev_checkpoint: str | None = None
    vocab: Vocab = field(default_factory=Vocab)

    @staticmethod
    def of(d: dict) -> TransformRequest:
        return TransformRequest(Transform.of(d["transform"]), [Input.of(i) for i in d["queryInputs"]], to_time(d["systemTime"]), int(d["nextOffset"]), d["newDataPath"], d["newCheckpointPath"], d.get("prevCheckpointPath"), Vocab.of(d.get("vocab")))


@dataclass
class RawQueryRequest:
    paths: list[str]
    transform: Transform
    output: str

    @staticmethod
    def of(d: dict) -> RawQueryRequest:
        return RawQueryRequest(list(d["inputDataPaths"]), Transform.of(d["transform"]), d["outputDataPath"])


@dataclass
class Success:
    interval: tuple[int, int] | None = None
    watermark: datetime | None = None
    num_records: int | None = None

    def to_dict(self) -> dict:
        if self.num_records is not None:
            return {"kind": "Success", "numRecords": self.num_records}
        return {"kind": "Success", "newOffsetInterval": {"start": self.interval[0], "end": self.interval[1]} if self.interval else None, "newWatermark": f"{self.watermark.isoformat()}Z" if self.watermark else None}


@dataclass
class Failure:
    kind: str  # InvalidQuery or InternalError
    message: str
    backtrace: str | None = None

    def to_dict(self) -> dict:
        return {"kind": self.kind, "message": self.message} | ({"backtrace": self.backtrace} if self.backtrace else {})
