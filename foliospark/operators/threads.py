"""Reply threads and comment changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import py_content, py_norm
from foliospark.operators.alignment import similarity, similarity_bound
from foliospark.operators.inline import segments, whole
from foliospark.tables import dropped, written

SIMILAR = 0.5
SAME_ROW = 0.5
#: Fields of a comment that a change carries along as they are, and of its anchor.
CARRIED = {"initials": "string", "date": "string", "done": "boolean", "on_deleted": "boolean", "on_inserted": "boolean"}
CHANGES = f"array<struct<state:string,old_id:long,new_id:long,author:string,cid:int,depth:int,{','.join(f'{k}:{v}' for k, v in CARRIED.items())},segments:array<struct<m:string,t:string>>>>"


def depths(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """df with depth: 0 without a parent, else one below it; rows that no root leads to are left out.

    Each row points at an ancestor, first its parent; a round makes it point at that one's ancestor, so a
    thread of depth d takes log2(d) rounds, each written to the shared folder. Rows that end in a missing
    parent drop out, and a round that brings no row to a root leaves only circles, which are left out.
    """
    steps = written(df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.when(F.col(parent_col).isNull(), 0).otherwise(1).alias("hops")), "threads")
    arrived = steps.filter("up IS NULL").count()
    while steps.filter("up IS NOT NULL").head(1):
        above = steps.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more")).dropDuplicates(["up"])
        moved = steps.filter("up IS NOT NULL").join(above, "up").select("id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"))
        new = written(steps.filter("up IS NULL").unionByName(moved), "threads")
        dropped(steps)
        steps, before, arrived = new, arrived, new.filter("up IS NULL").count()
        if arrived == before:
            break
    known = steps.filter("up IS NULL").select(F.col("id").alias("_thread_id"), F.col("hops").alias("depth")).dropDuplicates(["_thread_id"])
    return df.drop("depth").join(known, F.col(id_col) == F.col("_thread_id")).drop("_thread_id")


def match(old: list[dict], new: list[dict]) -> dict[int, int]:
    """Place in new -> place in old: greedy by likeness, authors equal, each at most once.

    New comments choose in the order of (author, text, id), the first of equals in old's order. Anchors
    on one row of the comparison (``row``, where known) add to the likeness.
    """
    taken: dict[int, int] = {}
    used: set[int] = set()
    tokens = [py_content(py_norm(c["text"])) for c in old]
    for j in sorted(range(len(new)), key=lambda j: (new[j]["author"], new[j]["text"], str(new[j]["id"]))):
        own = py_content(py_norm(new[j]["text"]))
        best, score = None, SIMILAR - 1e-9
        for i, c in enumerate(old):
            if i in used or c["author"] != new[j]["author"]:
                continue
            extra = SAME_ROW if c.get("row") is not None and c.get("row") == new[j].get("row") else 0
            if similarity_bound(tokens[i], own) + extra <= score:
                continue
            found = similarity(tokens[i], own) + extra
            if found > score:
                best, score = i, found
        if best is not None:
            taken[j] = best
            used.add(best)
    return taken


def reply_depths(comments: list[dict]) -> dict:
    """id -> how many replies down a comment is (``parent``: the id that it answers); a circle or a missing parent ends the way."""
    parent = {c["id"]: c.get("parent") for c in comments}
    out = {}
    for c in comments:
        seen, at = {c["id"]}, parent[c["id"]]
        while at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        out[c["id"]] = len(seen) - 1
    return out


def anchored(kind: str, segments: list[dict], side: str, start: int, end: int | None = None) -> bool:
    """Whether an anchor on a row's original (a) or revised (b) text lies on what the row deletes or inserts.

    The whole of a deleted or inserted row is; of a changed row the characters in segments of that mode are. Without
    an end the anchor is the one character at start.
    """
    mode, whole_row = ("del", "deleted") if side == "a" else ("ins", "inserted")
    if kind != "changed":
        return kind == whole_row
    stop, at = start + 1 if end is None else end, 0
    for s in segments:
        if s["m"] in ("eq", mode):
            if s["m"] == mode and start < at + len(s["t"]) and stop > at:
                return True
            at += len(s["t"])
    return False


def changes(old: list[dict], new: list[dict]) -> list[dict]:
    """Unchanged, edited, added and removed comments in reading order; all but the unchanged are numbered.

    ``pos`` is the reading place of a comment's anchor in the revised document, where known; comments without
    one come last. At one place a comment stands before its replies, and revised comments before removed ones.
    """
    partner = match(old, new)
    kept = set(partner.values())
    depth = reply_depths(new)
    entries = [(c, old[partner[j]] if j in partner else None, True) for j, c in enumerate(new)]
    entries += [(c, c, False) for i, c in enumerate(old) if i not in kept]
    place = lambda e: (e[0].get("pos") is None, e[0].get("pos") or 0, depth[e[0]["id"]] if e[2] else 0)
    out, flagged = [], 0
    for c, before, stands in sorted(entries, key=place):
        if not stands:
            state, cut = "removed", whole(c["text"], None, "del")
        elif before is None:
            state, cut = "added", whole(c["text"], None, "ins")
        elif py_norm(before["text"]) == py_norm(c["text"]):
            state, cut = "unchanged", whole(c["text"], None, "eq")
        else:
            state, cut = "edited", segments(before["text"], c["text"])
        flagged += state != "unchanged"
        out.append(
            {
                "state": state, "old_id": before and before["id"], "new_id": c["id"] if stands else None, "author": c["author"], "cid": flagged if state != "unchanged" else None,
                "depth": depth[c["id"]] if stands else 0, "segments": [{"m": s.mode, "t": s.text} for s in cut],
            }
            | {k: c.get(k) for k in CARRIED}
        )
    return out


def compare_comments(pairs: DataFrame) -> DataFrame:
    """a, b, pos and the fields of each comment change, of pairs with comments_a and comments_b."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cut = pa.list_(pa.struct([("m", pa.string()), ("t", pa.string())]))
        kind = pa.list_(pa.struct([("state", pa.string()), ("old_id", pa.int64()), ("new_id", pa.int64()), ("author", pa.string()), ("cid", pa.int32()), ("depth", pa.int32()), *((k, pa.bool_() if v == "boolean" else pa.string()) for k, v in CARRIED.items()), ("segments", cut)]))
        for a, b in batches:
            yield pa.array([changes(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    made = pairs.withColumn("_c", F.arrow_udf(run, CHANGES)(F.col("comments_a"), F.col("comments_b")))
    return made.select("a", "b", F.posexplode("_c").alias("pos", "c")).select("a", "b", "pos", "c.*")
