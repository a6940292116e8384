"""DuckDB SQL of the registered queries, from the definitions: brute force where the engine is clever."""

from __future__ import annotations

import math

from ..functions.projections import BESSEL, SWISS_LON, WGS84, SwissOblique
from ..sources import adapters

SPECIES = """species as (select p_partkey as species_id, concat(p_name, ' ', cast(p_partkey as varchar)) as species, p_type as grp,
  case when p_size <= 25 then 'aquatic' else 'terrestrial' end as habitat, cast(p_size as double) / 100 as dispersal_km from part)"""
DISTANCE = "group_distance as (select distinct grp, case when grp in ('ECONOMY', 'PROMO') then 'EuclideanDistance' else 'LCPDistance' end as distance from species)"
OBS = """obs as (select l_partkey as species_id, cast(floor((l_orderkey % 1024) / 32.0) as int) as row, cast((l_orderkey % 1024) % 32 as int) as col,
  avg(l_quantity * 2) as pct from lineitem group by 1, 2, 3)"""
PIXELS = f"{SPECIES}, {OBS}, pixels as (select habitat, grp, species_id, row, col, pct / 100 as value from obs join species using (species_id))"
MEANS = f"""{PIXELS}, means as (select habitat, grp, row, col, avg(value) as mean_suitability,
  sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)) as std_suitability, count(value) as valid_count from pixels group by all)"""
FRAME = "frame as (select cast(r as int) as row, cast(c as int) as col from range(32) a(r), range(32) b(c))"
DENSE = """dense as (select cast(vec_id as int) as row, cast(generate_subscripts(embedding, 1) - 1 as int) as col, cast(unnest(embedding) as double) + 0.6 as value from embeddings)"""


def _edges() -> str:
    rows = ", ".join(f"('{layer}', {g}, {x1}::double, {y1}::double, {x2}::double, {y2}::double)" for layer, g, x1, y1, x2, y2 in adapters.edge_rows())
    return f"edges(layer, geom_id, x1, y1, x2, y2) as (values {rows})"


EDGES = _edges()
#: Every cell against every edge.
POINTS = f"""{EDGES}, {FRAME}, points as (select row, col, (col + 0.5) * 25 as px, (31.5 - row) * 25 as py from frame),
inside as (select layer, geom_id, row, col from points, edges
  where (y1 <= py) <> (y2 <= py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) group by all having count(*) % 2 = 1),
filled as (select distinct layer, row, col from inside where layer in ('country', 'lake')),
clip1 as (select *, case when x2 <> x1 then least((px - 12.5 - x1) / (x2 - x1), (px + 12.5 - x1) / (x2 - x1)) end as ax,
  case when x2 <> x1 then greatest((px - 12.5 - x1) / (x2 - x1), (px + 12.5 - x1) / (x2 - x1)) end as bx,
  case when y2 <> y1 then least((py - 12.5 - y1) / (y2 - y1), (py + 12.5 - y1) / (y2 - y1)) end as ay,
  case when y2 <> y1 then greatest((py - 12.5 - y1) / (y2 - y1), (py + 12.5 - y1) / (y2 - y1)) end as b_y from points, edges),
touching as (select distinct layer, row, col from clip1 where (x1 <> x2 or abs(px - x1) <= 12.5) and (y1 <> y2 or abs(py - y1) <= 12.5)
  and greatest(0, coalesce(ax, 0), coalesce(ay, 0)) <= least(1, coalesce(bx, 1), coalesce(b_y, 1))),
distances as (select layer, row, col, min(power(px - x1 - t * (x2 - x1), 2) + power(py - y1 - t * (y2 - y1), 2)) as d2 from
  (select *, case when x1 = x2 and y1 = y2 then 0 else greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) end as t from points, edges)
  group by all),
lake_touched as (select row, col from filled where layer = 'lake' union select row, col from touching where layer = 'lake'),
aquatic as (select row, col from lake_touched union select row, col from touching where layer = 'river'),
lake_box as (select min(least(x1, x2)) as minx, min(least(y1, y2)) as miny, max(greatest(x1, x2)) as maxx, max(greatest(y1, y2)) as maxy from edges where layer = 'lake'),
terrestrial as (select row, col from points, lake_box where px between minx and maxx and py between miny and maxy
  except select row, col from filled where layer = 'lake'),
border as (select row, col from filled where layer = 'country')"""
_PLUS = f"{MEANS}, {POINTS}"
#: Mean rasters on the whole frame, missing beyond the border.
CLIPPED = f"""{_PLUS}, clipped as (select k.habitat, k.grp, f.row, f.col, m.mean_suitability as value from (select distinct habitat, grp from means) k cross join frame f
  left join (select * from means semi join border using (row, col)) m on m.habitat = k.habitat and m.grp = k.grp and m.row = f.row and m.col = f.col)"""

TRAITS_CLEAN = f"""with {SPECIES} select species_id, replace(species, '/', '_') as species, replace(grp, '/', '_') as grp, replace(habitat, '/', '_') as habitat, dispersal_km,
  coalesce(case when dispersal_km >= 0.1 then concat(grp, '_', habitat) end, 'nan') as note from species"""
GROUP_SPECIES = f"with {SPECIES} select species_id, species from species where grp = 'PROMO'"
REPEATED = f"{SPECIES}, repeated as (select species_id, p_name as species, grp, habitat, dispersal_km from species join part on p_partkey = species_id)"
FIRST = f"{REPEATED}, firsts as (select * from repeated qualify row_number() over (partition by species order by species_id) = 1)"
TRAIT_FIRST_VALUE = f"with {FIRST} select species, habitat, dispersal_km, grp from firsts"
SPECIES_IN_HABITAT = f"with {FIRST} select f.habitat, r.grp, r.species_id, r.species from repeated r join firsts f using (species)"
SPECIES_FILE_MATCH = f"""with {SPECIES}, files as (select concat('reg_', replace(species, ' ', '.'), '_reg_covariate_ensemble.tif') as file from species where species_id in (select l_partkey from lineitem))
select species_id, species, count(file) as n_files, case when count(file) = 1 then min(file) end as file
from species left join files on ends_with(file, concat(replace(species, ' ', '.'), '_reg_covariate_ensemble.tif')) group by all"""
AVAILABLE_SPECIES = """with files as (select concat('p', cast(p_partkey as varchar), '_', replace(p_name, ' ', '.'), '_reg_covariate_ensemble.tif') as file from part),
wanted as (select p_partkey as species_id, p_name as species from part
  union all select p_partkey, concat('p', cast(p_partkey as varchar), '_', p_name) from part)
select species_id, species, min(file) as file from wanted join files on ends_with(file, concat(replace(species, ' ', '.'), '_reg_covariate_ensemble.tif'))
group by all having count(*) = 1"""
DISPERSAL_STATS = f"with {SPECIES} select habitat, grp, count(*) as n_species, round(median(dispersal_km) * 1000, 6) as d_m, round(stddev_samp(dispersal_km) * 1000, 6) as d_m_std from species group by all"
SPECIES_LIST = f"with {SPECIES} select habitat, grp, string_agg(species, '|' order by species) as species from species group by all"
METADATA_REPORT = f"""with {SPECIES}, {DISTANCE} select grp, habitat, count(*) as species_number, distance, round(median(dispersal_km) * 1000 / 1000, 3) as median_dispersal_km,
  round(stddev_samp(dispersal_km) * 1000 / 1000, 2) as std_dispersal_km from species join group_distance using (grp) group by grp, habitat, distance"""


AVAILABLE_REPORT = f"""with {SPECIES}, files as (select concat('reg_', replace(species, ' ', '.'), '_reg_covariate_ensemble.tif') as file from species where species_id in (select l_partkey from lineitem))
select habitat, grp, species, dispersal_km as dispersal_range_km from species join files on ends_with(file, concat(replace(species, ' ', '.'), '_reg_covariate_ensemble.tif')) group by all having count(*) = 1"""


def display_values(names: dict[str, str]) -> str:
    rows = ", ".join(f"('{g}', '{n}')" for g, n in names.items())
    return f"with {SPECIES} select distinct grp, coalesce(display_name, grp) as display_name from species left join (values {rows}) v(grp, display_name) using (grp)"


GROUP_DIM = f"with {SPECIES}, {DISTANCE} select grp, distance from group_distance"
_JOBS = "select grp, distance, habitat from group_distance, (values ('aquatic'), ('terrestrial')) h(habitat)"
JOB_MATRIX = f"with {SPECIES}, {DISTANCE} {_JOBS}"
TASK_FILTER = f"with {SPECIES}, {DISTANCE} select grp, distance, habitat, sens from ({_JOBS}), (values ('permeability'), ('quality')) s(sens) where not (distance = 'EuclideanDistance' and sens = 'permeability')"

RASTER_LOAD_SCALED = f"with {OBS}, span as (select species_id, max(pct) > 1 and min(pct) < 100 as ok from obs group by 1) select species_id, row, col, case when ok then round(pct / 100, 6) end as value from obs join span using (species_id)"
SUITABILITY = f"with {PIXELS} select habitat, grp, row, col, {{what}} from pixels group by habitat, grp, row, col"
QUALITY_FLOOR = f"with {CLIPPED} select habitat, grp, row, col, round(case when coalesce(value, 0) = 0 then 1e-5 else value end, 6) as quality from clipped"
SIZE = "size as (select max(row) + 1 as h, 64 as w from dense)"
COARSEN = f"""with {DENSE}, {SIZE} select cast(floor(row / {{f}}.0) as int) as row, cast(floor(col / {{f}}.0) as int) as col, round(avg(value), 6) as value
from dense, size where row < h - h % {{f}} and col < w - w % {{f}} group by 1, 2"""
GRID_RESOLUTION = "select cast(25 as double) as lat, cast(25 as double) as lon"
GRID_ALIGN = f"""with {OBS}, {FRAME}, moved as (select cast(floor((800 - ((31.5 - row) * 25 - 5 + 40)) / 25) as int) as row, cast(floor(((col + 0.5) * 25 + 7 - 60) / 25) as int) as col, pct from obs),
snapped as (select row, col, avg(pct) as value from moved group by all)
select row, col, round(value, 6) as value from frame left join snapped using (row, col)"""
PAD_GRID = f"""with {MEANS}, big as (select habitat, grp, cast(r - 3 as int) as row, cast(c - 3 as int) as col from (select distinct habitat, grp from means), range(38) a(r), range(38) b(c))
select habitat, grp, row, col, round(mean_suitability, 6) as value from big left join means using (habitat, grp, row, col)"""
BAND_UNPIVOT = f"""with {MEANS} select habitat, grp, row, col, 'mean_suitability' as band, round(mean_suitability, 6) as value from means
union all select habitat, grp, row, col, 'std_suitability', round(std_suitability, 6) from means"""
BAND_PIVOT = f"with {MEANS} select habitat, grp, row, col, round(mean_suitability, 6) as mean_suitability, round(std_suitability, 6) as std_suitability from means"
INT16_PACK = f"with {DENSE} select row, col, cast(round(value / 0.001) as int) as packed, round(cast(round(value / 0.001) as int) * 0.001::double, 6) as decoded from dense"
RESCALE = f"""with {MEANS} select habitat, grp, row, col, round((mean_suitability - min(mean_suitability) over w) / nullif(max(mean_suitability) over w - min(mean_suitability) over w, 0), 6) as value
from means window w as (partition by habitat, grp)"""
LCP_ALPHA = f"""with {CLIPPED}, q as (select habitat, grp, case when coalesce(value, 0) = 0 then 1e-5 else value end as q from clipped)
select habitat, grp, round(1 / avg(q), 6) as mean_step, round(avg(q) * 25, 6) as alpha from q group by all"""
DOWNSCALE = f"""with {DENSE}, {SIZE}, coarse as (select cast(floor(row / 3.0) as int) as r, cast(floor(col / 3.0) as int) as c, avg(value) as v from dense, size where row < h - h % 3 and col < w - w % 3 group by 1, 2)
select row, col, round(v, 6) as value from dense join size on true left join coarse on r = cast(floor(row / 3.0) as int) and c = cast(floor(col / 3.0) as int)
  and row between 1 and h - h % 3 - 2 and col between 1 and w - w % 3 - 2"""
FILLED = f"""filled_cells as (select h.habitat, h.grp, h.row, h.col, coalesce(h.value,
  (arg_min(k.value, power(k.row - h.row, 2) * 1000000 + k.row * 1000 + k.col + power(k.col - h.col, 2) * 1000000))) as value
  from clipped h join clipped k on k.habitat = h.habitat and k.grp = h.grp and k.value is not null group by h.habitat, h.grp, h.row, h.col, h.value)"""
FILL_NEAREST = f"with {CLIPPED}, {FILLED} select habitat, grp, row, col, round(value, 6) as value from filled_cells"

#: Where the dense raster lies in the Swiss system, cells of the target grids, and where its corner lies on Mercator's map, about.
EAST, NORTH = 2_600_000.0, 1_200_000.0
MERCATOR_CELL, FINE, COARSE = 40.0, 10.0, 60.0
_X, _Y = 828_064.0, 5_934_090.0
_S = SwissOblique(EAST, NORTH)
#: The inverse map of every cell of a wide box: sphere, WGS 84 in space, the Bessel ellipsoid, its sphere, the oblique cylinder.
REPROJECT = f"""with {DENSE}, {SIZE}, box as (select (i + floor({_X} / 40.0) - 100 + 0.5) * 40.0 as x, (j + floor({_Y} / 40.0) + 100 - floor(h * 25 * 1.6 / 40) - 200 + 0.5) * 40.0 as y
  from size, range(400) a(i), lateral (select unnest(range(cast(floor(h * 25 * 1.6 / 40) + 200 as bigint))) as j)),
globe as (select x::double as x, y::double as y, x::double / 6378137.0 as lon, 2 * (atan(exp(y::double / 6378137.0)) - pi() / 4) as lat from box),
normal as (select *, 6378137.0 / sqrt(1 - {WGS84.e2!r} * sin(lat) * sin(lat)) as n from globe),
space as (select x, y, n * cos(lat) * cos(lon) - 674.374 as gx, n * cos(lat) * sin(lon) - 15.056 as gy, n * (1 - {WGS84.e2!r}) * sin(lat) - 405.346 as gz from normal),
angle as (select *, sqrt(gx * gx + gy * gy) as p, {BESSEL.a * math.sqrt(1 - BESSEL.e2)!r} as b from space), tilt as (select *, atan2(gz * {BESSEL.a!r}, p * b) as th from angle),
bessel as (select x, y, atan2(gy, gx) as lon, atan2(gz + {BESSEL.e2 / (1 - BESSEL.e2)!r} * b * power(sin(th), 3), p - {BESSEL.e2 * BESSEL.a!r} * power(cos(th), 3)) as lat from tilt),
sphere as (select x, y, {_S.alpha!r} * (lon - {SWISS_LON!r}) as l, 2 * (atan(exp({_S.alpha!r} * ln(tan(pi() / 4 + lat / 2)) - {_S.alpha * _S.e / 2!r} * ln((1 + {_S.e!r} * sin(lat)) / (1 - {_S.e!r} * sin(lat))) + {_S.k!r})) - pi() / 4) as bb from bessel),
turned as (select x, y, atan2(sin(l), sin({_S.b0!r}) * tan(bb) + cos({_S.b0!r}) * cos(l)) as lt, asin(cos({_S.b0!r}) * sin(bb) - sin({_S.b0!r}) * cos(bb) * cos(l)) as bt from sphere),
cell as (select x, y, cast(floor(-{_S.radius!r} / 2 * ln((1 + sin(bt)) / (1 - sin(bt))) / 25) as int) as row, cast(floor({_S.radius!r} * lt / 25) as int) as col from turned)
select x, y, round(value, 6) as value from cell join dense using (row, col)"""
GRID_MATCH = f"""with {DENSE}, {SIZE}, aim as (select {EAST} + {{x0}}::double + (c + 0.5) * {{r}}::double as x, {NORTH} + {{y0}}::double - (r + 0.5) * {{r}}::double as y
  from size, lateral (select unnest(range(cast(floor(h * 25 / {{r}}) as bigint))) as r), range(cast(floor(64 * 25 / {{r}}) as bigint)) b(c))
select x, y, round(value, 6) as value from aim join dense on row = cast(floor(({NORTH} - y) / 25) as int) and col = cast(floor((x - {EAST}) / 25) as int)"""
GRID_BILINEAR = f"""with {DENSE}, {SIZE}, aim as (select {EAST} + 5 + (c + 0.5) * {COARSE}::double as x, {NORTH} - 5 - (r + 0.5) * {COARSE}::double as y
  from size, lateral (select unnest(range(cast(floor(h * 25 / {COARSE}) as bigint))) as r), range(cast(floor(64 * 25 / {COARSE}) as bigint)) b(c)),
placed as (select x, y, ({NORTH} - y) / 25 - 0.5 as u, (x - {EAST}) / 25 - 0.5 as v from aim, size where {NORTH} - y < h * 25 and x - {EAST} < 1600)
select x, y, round(sum(value * (1 - abs(row - u)) * (1 - abs(col - v))) / sum((1 - abs(row - u)) * (1 - abs(col - v))), 6) as value
from placed join dense on abs(row - u) < 1 and abs(col - v) < 1 group by x, y"""
LABEL_MATCH = f"""with {DENSE}, xs as (select distinct abs(s_acctbal) % 64 as x from supplier), ys as (select distinct abs(s_acctbal) % 150 as y from supplier),
rows as (select distinct row from dense), cols as (select distinct col from dense),
nx as (select x, arg_min(col, (abs(col - x), col)) as col from xs, cols where x between (select min(col) from cols) and (select max(col) from cols) group by x),
ny as (select y, arg_min(row, (abs(row - y), row)) as row from ys, rows where y between (select min(row) from rows) and (select max(row) from rows) group by y)
select round(x, 6) as x, round(y, 6) as y, round(value, 6) as value from nx, ny join dense using (row) where dense.col = nx.col"""
TILED_BOX = f"""with {DENSE} select row, col, {EAST} + (col + 0.5) * 25.0::double as x, {NORTH} - (row + 0.5) * 25.0::double as y, round(value, 4) as v, round(value * value, 4) as square from dense where row between 10 and 74 and col between 5 and 39"""
DENSE_ALL = f"with {DENSE} select row, col, round(cast(cast(value as float) as double), 5) as value from dense"


def within(cells: str) -> str:
    """Mean percent of the observed cells among those that a query over POINTS selects."""
    return f"with {OBS}, {POINTS}, wanted as ({cells}) select row, col, round(avg(pct), 6) as value from obs semi join wanted using (row, col) group by row, col"


TOTAL_BOUNDS = f"with {OBS}, {POINTS} select minx, miny, maxx, maxy, count(*) as pixels from obs join points using (row, col), lake_box where px between minx and maxx and py between miny and maxy group by all"
MASK_SEMI = f"with {_PLUS} select habitat, grp, row, col, round(mean_suitability, 6) as value from means semi join (select row, col from filled where layer = 'lake') using (row, col)"
CROP_BORDER = f"with {_PLUS} select habitat, grp, row, col, round(mean_suitability, 6) as value from means semi join border using (row, col)"
BUFFER = "select row, col from filled where layer in ({layers}) union select row, col from distances where layer in ({layers}) and d2 <= {r} * {r}"
MASK_FILL = f"""with {CLIPPED}, {FILLED} select h.habitat, h.grp, h.row, h.col, round(coalesce(h.value, case when a.row is not null then f.value end), 6) as value
from clipped h left join filled_cells f on f.habitat = h.habitat and f.grp = h.grp and f.row = h.row and f.col = h.col left join aquatic a on a.row = h.row and a.col = h.col"""

PROXIMITY = f"""with {SPECIES}, stats as (select habitat, grp, median(dispersal_km) * 1000 as d_m from species group by all)
select habitat, grp, cast(d as int) as distance, round(exp(-d * 25.0::double / d_m), 6) as proximity from stats, range(16) r(d)"""
ANALYSIS_PARAMS = f"""with {SPECIES}, stats as (select habitat, grp, median(dispersal_km) * 1000 as d_m from species group by all), p as (select *, greatest(25.0::double, d_m * 0.2::double) as res from stats)
select habitat, grp, round(res, 6) as coarse_resolution, cast(ceil(res / 25) as int) as factor, cast(ceil(3.0::double * d_m / res) as int) as radius from p"""
SENSITIVITY_EUCLID = f"""with {DENSE}, offsets as (select a - 15 as dr, b - 15 as dc, exp(-sqrt(power(a - 15, 2) + power(b - 15, 2)) * 25.0 / 125.0) as k from range(31) x(a), range(31) y(b))
select s.row, s.col, round(2 * sum(k * t.value), 6) as sensitivity from dense s cross join offsets join dense t on t.row = s.row + dr and t.col = s.col + dc group by 1, 2"""
#: Relaxations of the least-cost SQL: enough for every path inside a window of 7 x 7 cells to settle.
ROUNDS = 14
_RELAXED = ",\n".join(
    f"d{k} as materialized (select sr, sc, tr, tc, min(d) as d from (select * from d{k - 1} union all select sr, sc, vr, vc, d + len * 2 / pp from d{k - 1} join steps on ur = tr and uc = tc where abs(vr - sr) <= 3 and abs(vc - sc) <= 3) group by all)"
    for k in range(1, ROUNDS + 1)
)
LCP = f"""{MEANS}, q as materialized (select row, col, mean_suitability as q from means where habitat = 'aquatic' and grp = 'PROMO'),
steps as materialized (select a.row as ur, a.col as uc, b.row as vr, b.col as vc, sqrt(power(a.row - b.row, 2) + power(a.col - b.col, 2)) as len, a.q + b.q as pp
  from q a join q b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and not (a.row = b.row and a.col = b.col)),
d0 as materialized (select row as sr, col as sc, row as tr, col as tc, 0.0::double as d from q),
{_RELAXED}, far as (select * from d{ROUNDS})"""
LCP_DISTANCE = f"with {LCP} select sr as row, sc as col, count(*) as reached, round(sum(d), 6) as distance_sum from far group by 1, 2"
SENSITIVITY_LCP_QUALITY = f"with {LCP} select sr as row, sc as col, round(2 * sum(exp(-d * 0.2::double) * q), 6) as sensitivity from far join q on q.row = tr and q.col = tc group by 1, 2"
#: Steps on shortest paths (within 1e-9), how many paths lead to each cell, and each pair's weight walked back over all of them by their share of the paths.
SENSITIVITY_LCP_PERMEABILITY = f"""with recursive {LCP},
arcs as materialized (select f.sr, f.sc, ur, uc, vr, vc, 2 * len / (pp * pp) as g from far f join steps on ur = f.tr and uc = f.tc
  join far e on e.sr = f.sr and e.sc = f.sc and e.tr = vr and e.tc = vc where abs(f.d + len * 2 / pp - e.d) < 1e-9),
ways as (select sr, sc, tr as vr, tc as vc from far where d = 0
  union all select k.sr, k.sc, a.vr, a.vc from ways k join arcs a on a.sr = k.sr and a.sc = k.sc and a.ur = k.vr and a.uc = k.vc),
paths as materialized (select sr, sc, vr, vc, count(*) as n from ways group by all),
shares as materialized (select a.*, p.n / e.n as share from arcs a join paths p on p.sr = a.sr and p.sc = a.sc and p.vr = a.ur and p.vc = a.uc
  join paths e on e.sr = a.sr and e.sc = a.sc and e.vr = a.vr and e.vc = a.vc),
pairs as (select sr, sc, tr, tc, a.q * b.q * exp(-d * 0.2::double) * 0.2::double as w from far join q a on a.row = sr and a.col = sc join q b on b.row = tr and b.col = tc where d > 0),
walk as (select sr, sc, tr as vr, tc as vc, w, 0.0::double as g, null::int as pr, null::int as pc from pairs
  union all select k.sr, k.sc, l.ur, l.uc, w * share, w * share * l.g, k.vr, k.vc from walk k join shares l on l.sr = k.sr and l.sc = k.sc and l.vr = k.vr and l.vc = k.vc),
ends as (select vr as row, vc as col, g from walk where pr is not null union all select pr, pc, g from walk where pr is not null)
select q.row, q.col, round(coalesce(sum(g), 0), 6) as sensitivity from q left join ends using (row, col) group by 1, 2"""

ELASTICITY_PRODUCT = f"with {_PLUS} select habitat, grp, row, col, round(2 * std_suitability * mean_suitability, 6) as elasticity from means semi join border using (row, col)"
SUMMED = f"""{MEANS}, summed as (select habitat, grp, row, col, case when grp in ('ECONOMY', 'PROMO') then mean_suitability
  when valid_count > 1 then mean_suitability + std_suitability end as value from means)"""
GROUP_SUM = f"with {SUMMED} select habitat, grp, row, col, round(value, 6) as value from summed"
SCORES = f"""{SUMMED}, logs as (select habitat, grp, row, col, ln(value + 1e-5) as v from summed),
groups as (select habitat, grp, row, col, (v - min(v) over (partition by habitat, grp)) / nullif(max(v) over (partition by habitat, grp) - min(v) over (partition by habitat, grp), 0) as v from logs),
folded as (select habitat, row, col, {{agg}}(v) as v from groups group by all),
scores as (select habitat, row, col, (v - min(v) over (partition by habitat)) / nullif(max(v) over (partition by habitat) - min(v) over (partition by habitat), 0) as v from folded)"""
ECIS = f"with {SCORES} select habitat, row, col, round(v, 6) as value from scores"
COMBINED = f"with {SCORES}, joint as (select row, col, {{agg}}(v) as v from scores group by all) select row, col, round((v - min(v) over ()) / nullif(max(v) over () - min(v) over (), 0), 6) as value from joint"
#: Closed cells of a wide frame against every edge of the country: where an edge enters a cell the distance is 0.
NEAR = """wide as (select cast(r - 64 as int) as row, cast(c - 64 as int) as col, (c - 63.5) * 25 as px, 800 - (r - 63.5) * 25 as py from range(160) a(r), range(160) b(c)),
outer_inside as (select row, col from wide, edges where layer = 'country' and (y1 <= py) <> (y2 <= py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) group by all having count(*) % 2 = 1),
corner as (select row, col, px + dx * 12.5 as qx, py + dy * 12.5 as qy, px, py from wide, (values (-1, -1), (-1, 1), (1, -1), (1, 1)) v(dx, dy)),
to_corner as (select row, col, power(qx - x1 - t * (x2 - x1), 2) + power(qy - y1 - t * (y2 - y1), 2) as d2 from
  (select *, greatest(0, least(1, ((qx - x1) * (x2 - x1) + (qy - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) as t from corner, edges where layer = 'country')),
to_end as (select row, col, power(greatest(abs(x1 - px) - 12.5, 0), 2) + power(greatest(abs(y1 - py) - 12.5, 0), 2) as d2 from wide, edges where layer = 'country'),
entered as (select row, col, 0 as d2 from (select *, least((px - 12.5 - x1) / (x2 - x1), (px + 12.5 - x1) / (x2 - x1)) as ax, greatest((px - 12.5 - x1) / (x2 - x1), (px + 12.5 - x1) / (x2 - x1)) as bx,
  least((py - 12.5 - y1) / (y2 - y1), (py + 12.5 - y1) / (y2 - y1)) as ay, greatest((py - 12.5 - y1) / (y2 - y1), (py + 12.5 - y1) / (y2 - y1)) as b_y from wide, edges where layer = 'country')
  where greatest(0, ax, ay) <= least(1, bx, b_y)),
near as (select row, col, min(d2) as d2 from (select row, col, d2 from to_corner union all select * from to_end union all select * from entered union all select row, col, 0 from outer_inside) group by all)"""
#: Species with exactly one file (files: parts that reach 100 % somewhere), in the habitat and with the dispersal of their name's first row.
JOB = f"""{OBS}, named as (select p_partkey as id, concat(p_name, ' ', p_brand) as species, p_type as grp, case when p_size <= 25 then 'aquatic' else 'terrestrial' end as habitat, cast(p_size as double) / 100 as dispersal_km from part),
firsts as (select species, habitat, dispersal_km from named qualify row_number() over (partition by species order by id) = 1),
files as (select id, concat('p', id, '_', replace(species, ' ', '.'), '_reg_covariate_ensemble.tif') as file from named where id in (select species_id from obs where pct >= 100)),
counted as (select species, min(id) as id from firsts join files on ends_with(file, concat(replace(species, ' ', '.'), '_reg_covariate_ensemble.tif')) group by species having count(*) = 1),
job as (select distinct n.grp, f.habitat, species, f.dispersal_km, c.id from named n join firsts f using (species) join counted c using (species)),
means as (select habitat, grp, row, col, avg(pct / 100) as mean_suitability, sqrt(greatest(avg(pct / 100 * pct / 100) - avg(pct / 100) * avg(pct / 100), 0)) as std_suitability from obs join job on id = species_id group by all)"""
SUITABILITY_METADATA = f"""with {JOB} select habitat, grp, round(median(dispersal_km) * 1000, 6) as d_m, round(stddev_samp(dispersal_km) * 1000, 6) as d_m_std, count(*) as n_species, string_agg(species, '|' order by species) as species from job group by habitat, grp"""
_JOB_CELLS = f"""with {JOB}, {POINTS}, {NEAR}, masks as (select 'aquatic' as habitat, row, col from aquatic union all select 'terrestrial', row, col from terrestrial),
reach as (select habitat, grp, median(dispersal_km) * 1000 * 3.0::double as reach from job group by all),
bounds as (select min(least(x1, x2)) as minx, min(least(y1, y2)) as miny, max(greatest(x1, x2)) as maxx, max(greatest(y1, y2)) as maxy from edges where layer = 'country'),
rect as (select habitat, grp, reach, least(0, floor((800.0::double - maxy - reach) / 25)) as top, greatest(32, ceil((800.0::double - miny + reach) / 25)) as bottom,
  least(0, floor((minx - reach) / 25)) as west, greatest(32, ceil((maxx + reach) / 25)) as east from reach, bounds),
padded as (select r.habitat, r.grp, w.row, w.col, mean_suitability as m, std_suitability as s from rect r join wide w on w.row >= top and w.row < bottom and w.col >= west and w.col < east
  join near n on n.row = w.row and n.col = w.col and d2 <= reach * reach left join means k on k.habitat = r.habitat and k.grp = r.grp and k.row = w.row and k.col = w.col),
hole as (select p.* from padded p join masks using (habitat, row, col) where m is null),
filled_hole as (select habitat, grp, row, col, arg_min(mean_suitability, key) as m, arg_min(std_suitability, key) as s
  from (select h.habitat, h.grp, h.row, h.col, k.mean_suitability, k.std_suitability, power(k.row - h.row, 2) * 1000000 + power(k.col - h.col, 2) * 1000000 + k.row * 1000 + k.col as key from hole h join means k on k.habitat = h.habitat and k.grp = h.grp) group by habitat, grp, row, col),
cells as (select p.habitat, p.grp, p.row, p.col, coalesce(p.m, f.m) as m, coalesce(p.s, f.s) as s from padded p left join filled_hole f using (habitat, grp, row, col))"""
GROUP_SUITABILITY = f"{_JOB_CELLS} select habitat, grp, row, col, round(m, 6) as mean_suitability, round(s, 6) as std_suitability from cells"
SUITABILITY_TILES = f"{_JOB_CELLS} select habitat, grp, row, col, round(cast(cast(m as float) as double), 5) as mean_suitability from cells where m is not null"
GROUP_ELASTICITY = f"""with {_PLUS}, stats as (select habitat, grp, median(dispersal_km) * 1000 as d_m from species where grp in ('ECONOMY', 'PROMO') group by all),
p as (select habitat, grp, d_m, greatest(25.0::double, d_m * 0.2::double) as res from stats), params as (select *, cast(ceil(res / 25) as int) as f, cast(ceil(3.0::double * d_m / res) as int) as radius from p),
whole as (select k.habitat, k.grp, fr.row, fr.col, m.mean_suitability as v, k.f from params k cross join frame fr left join means m on m.habitat = k.habitat and m.grp = k.grp and m.row = fr.row and m.col = fr.col),
coarse as (select habitat, grp, cast(floor(row / f) as int) as row, cast(floor(col / f) as int) as col, case when coalesce(avg(v), 0) = 0 then 1e-5 else avg(v) end as q
  from whole where row < 32 - 32 % f and col < 32 - 32 % f group by habitat, grp, cast(floor(row / f) as int), cast(floor(col / f) as int)),
sens as (select s.habitat, s.grp, s.row, s.col, 2 * sum(t.q * exp(-sqrt(power(t.row - s.row, 2) + power(t.col - s.col, 2)) * res / d_m)) as k
  from coarse s join params using (habitat, grp) join coarse t on t.habitat = s.habitat and t.grp = s.grp and abs(t.row - s.row) <= radius and abs(t.col - s.col) <= radius group by all)
select w.habitat, w.grp, 'quality' as sens, w.row, w.col, round(k * v, 6) as elasticity from whole w semi join border b on b.row = w.row and b.col = w.col
join sens on sens.habitat = w.habitat and sens.grp = w.grp and sens.row = cast(floor(w.row / f) as int) and sens.col = cast(floor(w.col / f) as int)
where v is not null and least(w.row, w.col) >= (f - 1) / 2.0 and greatest(w.row, w.col) <= 32 - 32 % f - 1 - (f - 1) / 2.0"""
