"""Queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from ..operators import incremental, snapshots
from ..session import table


def p1_found(spark, sf_dir):
    return snapshots.snapshot_changes(table(spark, sf_dir, "index_entities"), table(spark, sf_dir, "snapshots"))


def p5_found(spark, sf_dir):
    return incremental.replay(table(spark, sf_dir, "blob_log"), table(spark, sf_dir, "analyze_runs"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found}

SQL = {
    "p1_found": r"""
with d as (select distinct snapshot_id, repo, source_root, taken_at, n_entities from snapshots),
x as (select snapshot_id, replace(id, '\', '/') id,
        max(nullif(regexp_replace(lower(content_hash), '^sha256:', ''), '')) h,
        max(list_sort(list_distinct(list_transform(coalesce(edges_out, []), lambda e: replace(e, '\', '/'))))) e
      from index_entities where id is not null group by 1, 2),
c as (select d.*, row_number() over (partition by repo, source_root order by taken_at) n
      from d join (select snapshot_id, count(*) k from x group by 1) using (snapshot_id) where k = n_entities),
a as (select c.repo, c.source_root, c.n, c.snapshot_id, x.id, x.h, x.e from x join c using (snapshot_id)),
b as (select a.repo, a.source_root, a.n + 1 n, s.snapshot_id, a.id, a.h, a.e
      from a join c s on s.repo = a.repo and s.source_root = a.source_root and s.n = a.n + 1)
select coalesce(l.snapshot_id, b.snapshot_id) snapshot_id, coalesce(l.id, b.id) entity_id,
       case when b.id is null then 'added' when l.id is null then 'removed' else 'changed' end change_type
from (select * from a where n > 1) l full join b on l.snapshot_id = b.snapshot_id and l.id = b.id
where b.id is null or l.id is null or l.h <> b.h or l.e <> b.e""",
    "p5_found": r"""
with l as (select repo, source_root, regexp_replace(regexp_replace(replace(display_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') p,
        lower(blob_sha) b, log_id, scanned_at, landed_at from blob_log where blob_sha is not null),
r as (select run_id, repo, source_root, started_at s,
        lag(started_at) over (partition by repo, source_root order by started_at, run_id) s0
      from analyze_runs where outcome = 'succeeded'),
now as (select r.run_id, r.s0, l.p, arg_max(l.b, (l.scanned_at, l.log_id)) b
        from r join l on l.repo = r.repo and l.source_root = r.source_root and l.landed_at <= r.s group by all),
was as (select r.run_id, l.p, arg_max(l.b, (l.scanned_at, l.log_id)) b
        from r join l on l.repo = r.repo and l.source_root = r.source_root and l.landed_at <= r.s0 group by all)
select now.run_id, now.p display_path, now.b blob_sha from now left join was on was.run_id = now.run_id and was.p = now.p
where was.b is distinct from now.b""",
}
