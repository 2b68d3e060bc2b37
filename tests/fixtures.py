"""Variants of the smallest tables for the edge cases."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

#: Ids that must stay unique and filled, as the tables define them.
IDS = {"box_row_id", "core_row_id", "event_id", "anthro_row_id", "name_id", "record_id", "doc_id", "item_id", "l_orderkey", "o_orderkey", "c_custkey", "load_id"}
LONG = "word " * 20_000 + "Ã©nd"
ODD = ["", "   ", " ", "�", "ÃÃÃ", LONG, "\u0000x", "ﬁ ①", "{", '{"a": ', "a" * 5_000]


def write_empty(source: Path, target: Path) -> str:
    for p in source.glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), target / p.name)
    return str(target)


def write_hostile(source: Path, target: Path) -> str:
    for p in source.glob("*.parquet"):
        t = pq.read_table(p)
        if p.stem == "split_plan":
            pq.write_table(t, target / p.name)
            continue
        columns = {}
        for k, name in enumerate(t.column_names):
            values = t[name].to_pylist()
            if name not in IDS:
                for i in range(k % 7, len(values), 13 + k):
                    values[i] = None
                if pa.types.is_string(t.schema.field(name).type) and name not in ("feed_id", "file_name", "nba_player_id", "athlete_id", "college_espn_id", "team_id"):
                    for j, odd in enumerate(ODD):
                        if 20 + 3 * j < len(values):
                            values[20 + 3 * j] = odd
            columns[name] = pa.array(values, t.schema.field(name).type)
        made = pa.table(columns)
        id_column = next((c for c in made.column_names if c in IDS - {"load_id"}), None)
        if id_column and p.stem not in ("lineitem", "orders", "customer", "events", "embeddings"):
            again = made.slice(0, min(5, made.num_rows))
            again = again.set_column(again.column_names.index(id_column), id_column, pa.array([10_000_000 + i for i in range(again.num_rows)], made.schema.field(id_column).type))
            made = pa.concat_tables([made, again])
        for extra in ("group", "component", "value", "token", "n", "_day"):
            if extra not in made.column_names:
                made = made.append_column(extra, pa.array(["x"] * made.num_rows))
        pq.write_table(made, target / p.name)
    return str(target)
