"""DuckDB SQL for the rows of those queries that SQL can express: whole-number rounds of codebooks and centroids, spelled out."""

from __future__ import annotations

from . import clusters, codes


def vector_codes() -> str:
    """op11 for vectors of 64 components: each part has 4, as a list; entry e of part p is in books(p, e, c)."""
    size = 64 // codes.PARTS
    apart = " + ".join(f"(c[{i}] - b[{i}]) * (c[{i}] - b[{i}])" for i in range(1, size + 1))
    means = ", ".join(f"cast(floor(sum(c[{i}]) / count(*)) as bigint)" for i in range(1, size + 1))
    out = [
        f"with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({codes.SCALE} * cast(x as double)) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"parts as materialized (select vec_id, label, p, v[p * {size} + 1 : p * {size} + {size}] as c from kept, range({codes.PARTS}) r(p))",
        f"first_ids as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit {codes.ENTRIES})",
        "books0 as materialized (select p, e, c as b from parts join first_ids using (vec_id))",
    ]
    for r in range(codes.ROUNDS + 1):
        out.append(f"near{r} as materialized (select vec_id, label, p, c, min(d) as d, arg_min(e, d * {codes.ENTRIES} + e) as e from (select vec_id, label, p, c, e, {apart} as d from parts join books{r} using (p)) group by vec_id, label, p, c)")
        if r < codes.ROUNDS:
            out.append(f"means{r} as (select p, e, [{means}] as m from near{r} group by p, e)")
            out.append(f"books{r + 1} as materialized (select p, e, coalesce(m, b) as b from books{r} left join means{r} using (p, e))")
    last = codes.ROUNDS
    return ", ".join(out) + (
        f", coded as (select vec_id, label, string_agg(lpad(printf('%x', e), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from near{last} group by vec_id, label), "
        f"digest as (select sha256(string_agg(array_to_string(b, ','), ',' order by p, e)) as codebooks_sha256 from books{last}) "
        "select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, digest"
    )


def centroid_clusters() -> str:
    """op12: centroid k is in centroids(k, c)."""
    k = clusters.CENTROIDS
    apart = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, clusters.WIDTH + 1))
    means = ", ".join(f"cast(floor(sum(v[{i}]) / count(*)) as bigint)" for i in range(1, clusters.WIDTH + 1))
    out = [
        f"with kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({clusters.SCALE} * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {clusters.WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"centroids0 as materialized (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, v as c from kept order by sha256('1:' || vec_id) limit {k})",
    ]
    for r in range(clusters.ROUNDS + 1):
        out.append(f"near{r} as materialized (select vec_id, v, min(d) as d, arg_min(k, d * {k} + k) as k from (select vec_id, v, k, {apart} as d from kept, centroids{r}) group by vec_id, v)")
        if r < clusters.ROUNDS:
            out.append(f"means{r} as (select k, [{means}] as m from near{r} group by k)")
            out.append(f"centroids{r + 1} as materialized (select k, coalesce(m, c) as c from centroids{r} left join means{r} using (k))")
    last = clusters.ROUNDS
    return ", ".join(out) + (
        f" select vec_id, cast(k as integer) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from near{last} join centroids{last} using (k)"
    )
