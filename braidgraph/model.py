"""The graph as DataFrames.

segments     node_id bigint, name, sequence, seq_len bigint, tags map<string, struct<type, value>>
links        link_idx bigint, from_id, from_orient, to_id, to_orient, overlap_num, overlap_op, overlap (as read), tags
steps        kind ('P' or 'W'), trav, pos bigint (0, 1, 2, ... without gaps), snode bigint (negative: reverse)
paths        trav, name, overlaps
walks        trav, sample_id, hap_index bigint, seq_id, seq_start, seq_end (null: *)
jumps        jump_idx, from_id, from_orient, to_id, to_orient, distance, rest
containments containment_idx, container_id, container_orient, contained_id, contained_orient, pos, overlap, rest
header       line (one row, or none)

Traversals are kept as one row per step, not as arrays, so that a chromosome-long path is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import Enum

from pyspark.sql import DataFrame


class Grouping(Enum):
    """What counts as one haplotype."""

    PATH = "path"
    SAMPLE_HAP_SEQ = "sample-hap-seq"
    SAMPLE_HAP = "sample-hap"
    SAMPLE = "sample"

    @classmethod
    def of(cls, name: str | Grouping) -> Grouping:
        # fixed values: other names of the modes on the command line
        other = {"per-line": "path", "panacus": "sample-hap-seq", "haplotype": "sample-hap"}
        return name if isinstance(name, Grouping) else cls(other.get(name, name))


@dataclass
class PangenomeGraph:
    """Lazily evaluated tables of one graph; any may be None where a caller does not need it."""

    segments: DataFrame
    steps: DataFrame
    paths: DataFrame | None = None
    walks: DataFrame | None = None
    links: DataFrame | None = None
    jumps: DataFrame | None = None
    containments: DataFrame | None = None
    header: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}


TAGS = "map<string,struct<type:string,value:string>>"
SCHEMAS = {
    "segments": f"node_id bigint, name string, sequence string, seq_len bigint, tags {TAGS}",
    "steps": "kind string, trav bigint, pos bigint, snode bigint",
    "paths": "trav bigint, name string, overlaps string",
    "walks": "trav bigint, sample_id string, hap_index bigint, seq_id string, seq_start bigint, seq_end bigint",
    "links": f"link_idx bigint, from_id bigint, from_orient string, to_id bigint, to_orient string, overlap_num bigint, overlap_op string, overlap string, tags {TAGS}",
    "jumps": "jump_idx bigint, from_id bigint, from_orient string, to_id bigint, to_orient string, distance string, rest string",
    "containments": "containment_idx bigint, container_id bigint, container_orient string, contained_id bigint, contained_orient string, pos bigint, overlap string, rest string",
    "header": "line string",
}
