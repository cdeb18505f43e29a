"""Spherical geometry as Spark SQL expressions.

Every function takes SQL operands (column names, field paths, sub-expressions
or numbers) and returns SQL text for ``F.expr`` / ``selectExpr``. Text keeps
planning cheap, works inside lambdas, and stays within whole-stage codegen.
Positions are degrees, separations arcseconds, time differences minutes.
"""

from __future__ import annotations

import math

# Mean obliquity of the ecliptic at J2000, degrees.
OBLIQUITY_J2000 = 84381.406 / 3600.0


def sql(value) -> str:
    """An operand as SQL text; numbers become DOUBLE literals."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return f"{float(value)!r}D"
    return f"({value})"


def wrap360(angle) -> str:
    """Angle folded into [0, 360)."""
    folded = f"pmod({angle}, 360D)"
    return f"(CASE WHEN {folded} >= 360D THEN 0D ELSE {folded} END)"


def angle_difference(a, b) -> str:
    """a - b folded into [-180, 180)."""
    return f"(pmod({sql(a)} - {sql(b)} + 180D, 360D) - 180D)"


def separation(ra1, dec1, ra2, dec2) -> str:
    """Great-circle distance (Vincenty form: exact at all scales), arcsec."""
    d1, d2 = f"radians({sql(dec1)})", f"radians({sql(dec2)})"
    dra = f"radians({sql(ra2)} - {sql(ra1)})"
    a = f"cos({d2}) * sin({dra})"
    b = f"cos({d1}) * sin({d2}) - sin({d1}) * cos({d2}) * cos({dra})"
    c = f"sin({d1}) * sin({d2}) + cos({d1}) * cos({d2}) * cos({dra})"
    return f"(degrees(atan2(hypot({a}, {b}), {c})) * 3600D)"


def separation_haversine(ra1, dec1, ra2, dec2) -> str:
    """Great-circle distance (haversine form), arcsec."""
    d1, d2 = f"radians({sql(dec1)})", f"radians({sql(dec2)})"
    s1 = f"sin(({d2} - {d1}) / 2D)"
    s2 = f"sin(radians({sql(ra2)} - {sql(ra1)}) / 2D)"
    h = f"{s1} * {s1} + cos({d1}) * cos({d2}) * {s2} * {s2}"
    return f"(degrees(2D * asin(sqrt(least(greatest({h}, 0D), 1D)))) * 3600D)"


def bearing(ra1, dec1, ra2, dec2) -> str:
    """Direction from point 1 to point 2, east of north, radians."""
    d1, d2 = f"radians({sql(dec1)})", f"radians({sql(dec2)})"
    dra = f"radians({sql(ra2)} - {sql(ra1)})"
    north = f"cos({d1}) * sin({d2}) - sin({d1}) * cos({d2}) * cos({dra})"
    return f"atan2(sin({dra}) * cos({d2}), {north})"


def position_angle(ra1, dec1, ra2, dec2) -> str:
    """Direction from point 1 to point 2 in [0, 360) degrees."""
    return wrap360(f"degrees({bearing(ra1, dec1, ra2, dec2)})")


def offset_position(ra, dec, direction, distance) -> tuple[str, str]:
    """(ra, dec) at a direction (radians) and signed distance (arcsec)."""
    d0 = f"radians({sql(dec)})"
    r = f"radians({sql(distance)} / 3600D)"
    b = sql(direction)
    up = f"(sin({d0}) * cos({r}) + cos({d0}) * sin({r}) * cos({b}))"
    dlon = f"atan2(sin({b}) * sin({r}) * cos({d0}), cos({r}) - sin({d0}) * {up})"
    new_ra = wrap360(f"({sql(ra)} + degrees({dlon}))")
    return new_ra, f"degrees(asin(least(greatest({up}, -1D), 1D)))"


def motion_vector(ra1, dec1, ra2, dec2, minutes) -> dict[str, str]:
    """Rate and direction of a motion; a non-positive time step is an error."""
    message = "the second time must be later than the first"
    dt = f"(CASE WHEN {sql(minutes)} > 0 THEN {sql(minutes)} ELSE raise_error('{message}') END)"
    dt = f"CAST({dt} AS DOUBLE)"
    sep = separation(ra1, dec1, ra2, dec2)
    return {
        "time_delta_minutes": dt,
        "separation_arcsec": sep,
        "rate_arcsec_per_min": f"({sep} / {dt})",
        "position_angle_deg": position_angle(ra1, dec1, ra2, dec2),
    }


def predict(ra1, dec1, ra2, dec2, minutes_between, minutes_after) -> tuple[str, str]:
    """Position after moving on along the great circle 1 -> 2 at its rate.

    ``minutes_after`` counts from point 2 and may be negative.
    """
    heading = f"({bearing(ra2, dec2, ra1, dec1)} + pi())"
    distance = (
        f"({separation(ra1, dec1, ra2, dec2)} * {sql(minutes_after)} / {sql(minutes_between)})"
    )
    return offset_position(ra2, dec2, heading, distance)


def sky_offsets(ra, dec, ra0, dec0) -> tuple[str, str]:
    """(east, north) in arcsec in the frame rotated onto an origin."""
    d, d0 = f"radians({sql(dec)})", f"radians({sql(dec0)})"
    dra = f"radians({sql(ra)} - {sql(ra0)})"
    along = f"cos({d}) * cos({dra}) * cos({d0}) + sin({d}) * sin({d0})"
    up = f"sin({d}) * cos({d0}) - cos({d}) * cos({dra}) * sin({d0})"
    east = f"(degrees(atan2(cos({d}) * sin({dra}), {along})) * 3600D)"
    return east, f"(degrees(asin(least(greatest({up}, -1D), 1D))) * 3600D)"


def gnomonic(ra, dec, ra0, dec0) -> tuple[str, str]:
    """Tangent-plane coordinates (radians) about a centre."""
    d, d0 = f"radians({sql(dec)})", f"radians({sql(dec0)})"
    dra = f"radians({sql(ra)} - {sql(ra0)})"
    depth = f"(sin({d0}) * sin({d}) + cos({d0}) * cos({d}) * cos({dra}))"
    xi = f"(cos({d}) * sin({dra}) / {depth})"
    eta = f"((cos({d0}) * sin({d}) - sin({d0}) * cos({d}) * cos({dra})) / {depth})"
    return xi, eta


def gnomonic_inverse(xi, eta, ra0, dec0) -> tuple[str, str]:
    """(ra, dec) of tangent-plane coordinates (radians) about a centre."""
    x, y = sql(xi), sql(eta)
    d0 = f"radians({sql(dec0)})"
    ra = wrap360(f"(degrees(atan2({x}, cos({d0}) - {y} * sin({d0}))) + {sql(ra0)})")
    norm = f"sqrt(1D + {x} * {x} + {y} * {y})"
    return ra, f"degrees(asin((sin({d0}) + {y} * cos({d0})) / {norm}))"


def unit_vector(ra, dec) -> tuple[str, str, str]:
    r, d = f"radians({sql(ra)})", f"radians({sql(dec)})"
    return f"(cos({d}) * cos({r}))", f"(cos({d}) * sin({r}))", f"sin({d})"


def vector_position(x, y, z) -> tuple[str, str]:
    """(ra, dec) of a direction that need not have unit length."""
    x, y, z = sql(x), sql(y), sql(z)
    return wrap360(f"degrees(atan2({y}, {x}))"), f"degrees(atan2({z}, hypot({x}, {y})))"


def array_sum(values) -> str:
    return f"aggregate({values}, 0D, (acc, v) -> acc + v)"


def mean_position_array(points) -> tuple[str, str]:
    """Spherical mean of an array of structs with ``ra`` and ``dec``."""
    parts = unit_vector("p.ra", "p.dec")
    return vector_position(*[array_sum(f"transform({points}, p -> {v})") for v in parts])


def extrapolate(ra, dec, ra_rate_per_hour, dec_rate_per_hour, minutes) -> tuple[str, str]:
    """Linear sky motion from hourly rates (arcsec), small offsets."""
    hours = f"({sql(minutes)} / 60D)"
    new_dec = f"({sql(dec)} + {sql(dec_rate_per_hour)} * {hours} / 3600D)"
    shift = f"{sql(ra_rate_per_hour)} * {hours} / 3600D / cos(radians({sql(dec)}))"
    return wrap360(f"({sql(ra)} + {shift})"), new_dec


def predicted_motion(ra_rate_per_hour, dec_rate_per_hour) -> tuple[str, str]:
    """(arcsec/min, direction in degrees) of hourly rates."""
    east, north = sql(ra_rate_per_hour), sql(dec_rate_per_hour)
    return f"(hypot({east}, {north}) / 60D)", wrap360(f"degrees(atan2({east}, {north}))")


def ecliptic_latitude(ra, dec) -> str:
    """Latitude above the J2000 mean ecliptic, degrees."""
    eps = math.radians(OBLIQUITY_J2000)
    _, y, z = unit_vector(ra, dec)
    return f"degrees(asin({z} * {math.cos(eps)!r}D - {y} * {math.sin(eps)!r}D))"


def pair_separations(points) -> str:
    """Separations (arcsec) of all pairs of an array of (ra, dec) structs."""
    inner = f"transform(slice({points}, i + 2, size({points})), q -> "
    inner += separation("p.ra", "p.dec", "q.ra", "q.dec") + ")"
    return f"flatten(transform({points}, (p, i) -> {inner}))"


def baseline_eligible(points, tolerance, factor: float = 2.0) -> str:
    """Every pair of positions is at least ``factor`` tolerances apart."""
    return f"forall({pair_separations(points)}, s -> s >= {sql(tolerance)} * {factor!r}D)"


# --- polygons: arrays of struct<x double, y double> ------------------------


def project_points(points, ra0, dec0, projection=gnomonic) -> str:
    """Plane coordinates of an array of (ra, dec) structs."""
    x, y = projection("p.ra", "p.dec", ra0, dec0)
    return f"transform({points}, p -> named_struct('x', {x}, 'y', {y}))"


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sort_around_centre(points) -> str:
    """Polygon corners ordered by angle about their mean."""
    mx = f"({array_sum('transform(_pts, p -> p.x)')} / size(_pts))"
    my = f"({array_sum('transform(_pts, p -> p.y)')} / size(_pts))"
    keyed = (
        "transform(_pts, p -> named_struct('a', atan2(p.y - _mid.y, p.x - _mid.x),"
        " 'x', p.x, 'y', p.y))"
    )
    ordered = f"transform(array_sort({keyed}), p -> named_struct('x', p.x, 'y', p.y))"
    return let("_pts", points, let("_mid", f"named_struct('x', {mx}, 'y', {my})", ordered))


def polygon_edges(points) -> str:
    """Array of struct<x1,y1,x2,y2> closing the polygon."""
    following = f"concat(slice({points}, 2, size({points})), slice({points}, 1, 1))"
    return (
        f"zip_with({points}, {following}, (a, b) -> "
        "named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))"
    )


def point_in_polygon(x, y, edges) -> str:
    """Even-odd rule over an edge array: an edge counts when it straddles y
    right of x. The edges may be a column, computed once per polygon."""
    x, y = sql(x), sql(y)
    crossed = (
        f"filter({edges}, e -> ((e.y1 > {y}) != (e.y2 > {y})) AND "
        f"{x} < e.x1 + ({y} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1))"
    )
    return f"(size({crossed}) % 2 = 1)"


def footprint_columns(corners: str) -> list[str]:
    """``selectExpr`` columns describing a footprint for ``in_footprint``:
    its centre and its plane edges (corner order does not matter)."""
    ra0, dec0 = mean_position_array(corners)
    plane = sort_around_centre("fp_plane")
    return [
        f"{ra0} AS fp_ra",
        f"{dec0} AS fp_dec",
        f"{project_points(corners, 'fp_ra', 'fp_dec')} AS fp_plane",
        f"{plane} AS fp_sorted",
        f"{polygon_edges('fp_sorted')} AS fp_edges",
    ]


def in_footprint(ra, dec) -> str:
    """Position inside the footprint of ``footprint_columns``."""
    return point_in_polygon(*gnomonic(ra, dec, "fp_ra", "fp_dec"), "fp_edges")


def offset_footprint_columns(corners: str, ra0: str, dec0: str) -> list[str]:
    """Footprint in sky offsets about the frame centre, corners as given."""
    return [
        f"{project_points(corners, ra0, dec0, sky_offsets)} AS of_plane",
        f"{polygon_edges('of_plane')} AS of_edges",
    ]


def in_offset_footprint(ra, dec, ra0, dec0) -> str:
    """Position inside the footprint of ``offset_footprint_columns``."""
    return point_in_polygon(*sky_offsets(ra, dec, ra0, dec0), "of_edges")


def polygon_area(edges) -> str:
    """Shoelace area in the units of the coordinates."""
    terms = f"transform({edges}, e -> e.x1 * e.y2 - e.x2 * e.y1)"
    return f"(abs({array_sum(terms)}) * 0.5D)"


def edge_distance(ra, dec, corners) -> str:
    """Distance (arcsec, tangent plane at the point) to the nearest edge."""
    plane = sort_around_centre(project_points(corners, ra, dec))
    t = (
        "least(greatest((-e.x1 * (e.x2 - e.x1) - e.y1 * (e.y2 - e.y1)) / "
        "(pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2)), 0D), 1D)"
    )
    reach = f"hypot(e.x1 + {t} * (e.x2 - e.x1), e.y1 + {t} * (e.y2 - e.y1))"
    nearest = f"array_min(transform({polygon_edges('_plane')}, e -> {reach}))"
    return f"(degrees({let('_plane', plane, nearest)}) * 3600D)"


def display_pixel(ra, dec, g: dict) -> tuple[str, str]:
    """Display pixel of a sky position from a linear tangent-plane geometry.

    ``g`` gives SQL operands for ``crval1, crval2, crpix1, crpix2, cd11, cd12,
    cd21, cd22, width, height`` and the booleans ``transposed, flip_x,
    flip_y``. Null when the position is behind the plane. Distortion terms
    are not modelled.
    """
    v = {k: sql(x) for k, x in g.items()}
    xi, eta = (f"degrees({t})" for t in gnomonic(ra, dec, g["crval1"], g["crval2"]))
    det = f"({v['cd11']} * {v['cd22']} - {v['cd12']} * {v['cd21']})"
    px = f"(({v['cd22']} * {xi} - {v['cd12']} * {eta}) / {det} + {v['crpix1']} - 1D)"
    py = f"(({v['cd11']} * {eta} - {v['cd21']} * {xi}) / {det} + {v['crpix2']} - 1D)"
    t = v["transposed"]
    a, b = f"if({t}, {py}, {px})", f"if({t}, {px}, {py})"
    wide = f"if({t}, {v['height']}, {v['width']})"
    high = f"if({t}, {v['width']}, {v['height']})"
    x = f"if({v['flip_x']}, {wide} - 1D - {a}, {a})"
    y = f"if({v['flip_y']}, {high} - 1D - {b}, {b})"
    ahead = f"{separation(ra, dec, g['crval1'], g['crval2'])} < 324000D"
    return f"(CASE WHEN {ahead} THEN {x} END)", f"(CASE WHEN {ahead} THEN {y} END)"
