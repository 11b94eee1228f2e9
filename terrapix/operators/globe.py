"""Hexagons of the sphere: cells of the public H3 grid, hierarchical 64-bit numbers, as column expressions.

The sphere is projected onto the 20 faces of an icosahedron. A face has a lattice of hexagons; a finer level has seven
cells for one and is turned by about 19 degrees, alternately to either side. A number holds the level, one of 122 base
cells (12 of them pentagons) and a digit of 0 to 6 a level: the child's direction from its parent's centre.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grid: the faces' centres (latitude, longitude) and the azimuth of a face's first axis, in radians.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# Fixed values of the grid: face and lattice place (i, j, k) of the base cells, in the order of their numbers.
HOMES = (
    (1, 1, 0, 0), (2, 1, 1, 0), (1, 0, 0, 0), (2, 1, 0, 0), (0, 2, 0, 0), (1, 1, 1, 0), (1, 0, 0, 1), (2, 0, 0, 0),
    (0, 1, 0, 0), (2, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1), (3, 1, 0, 0), (3, 1, 1, 0), (11, 2, 0, 0), (4, 1, 0, 0),
    (0, 0, 0, 0), (6, 0, 1, 0), (0, 0, 0, 1), (2, 0, 1, 1), (7, 0, 0, 1), (2, 0, 0, 1), (0, 1, 1, 0), (6, 0, 0, 1),
    (10, 2, 0, 0), (6, 0, 0, 0), (3, 0, 0, 0), (11, 1, 0, 0), (4, 1, 1, 0), (3, 0, 1, 0), (0, 0, 1, 1), (4, 0, 0, 0),
    (5, 0, 1, 0), (0, 0, 1, 0), (7, 0, 1, 0), (11, 1, 1, 0), (7, 0, 0, 0), (10, 1, 0, 0), (12, 2, 0, 0), (6, 1, 0, 1),
    (7, 1, 0, 1), (4, 0, 0, 1), (3, 0, 0, 1), (3, 0, 1, 1), (4, 0, 1, 0), (6, 1, 0, 0), (11, 0, 0, 0), (8, 0, 0, 1),
    (5, 0, 0, 1), (14, 2, 0, 0), (5, 0, 0, 0), (12, 1, 0, 0), (10, 1, 1, 0), (4, 0, 1, 1), (12, 1, 1, 0), (7, 1, 0, 0),
    (11, 0, 1, 0), (10, 0, 0, 0), (13, 2, 0, 0), (10, 0, 0, 1), (11, 0, 0, 1), (9, 0, 1, 0), (8, 0, 1, 0), (6, 2, 0, 0),
    (8, 0, 0, 0), (9, 0, 0, 1), (14, 1, 0, 0), (5, 1, 0, 1), (16, 0, 1, 1), (8, 1, 0, 1), (5, 1, 0, 0), (12, 0, 0, 0),
    (7, 2, 0, 0), (12, 0, 1, 0), (10, 0, 1, 0), (9, 0, 0, 0), (13, 1, 0, 0), (16, 0, 0, 1), (15, 0, 1, 1), (15, 0, 1, 0),
    (16, 0, 1, 0), (14, 1, 1, 0), (13, 1, 1, 0), (5, 2, 0, 0), (8, 1, 0, 0), (14, 0, 0, 0), (9, 1, 0, 1), (14, 0, 0, 1),
    (17, 0, 0, 1), (12, 0, 0, 1), (16, 0, 0, 0), (17, 0, 1, 1), (15, 0, 0, 1), (16, 1, 0, 1), (9, 1, 0, 0), (15, 0, 0, 0),
    (13, 0, 0, 0), (8, 2, 0, 0), (13, 0, 1, 0), (17, 1, 0, 1), (19, 0, 1, 0), (14, 0, 1, 0), (19, 0, 1, 1), (17, 0, 1, 0),
    (13, 0, 0, 1), (17, 0, 0, 0), (16, 1, 0, 0), (9, 2, 0, 0), (15, 1, 0, 1), (15, 1, 0, 0), (18, 0, 1, 1), (18, 0, 0, 1),
    (19, 0, 0, 1), (17, 1, 0, 0), (19, 0, 0, 0), (18, 0, 1, 0), (18, 1, 0, 1), (19, 2, 0, 0), (19, 1, 0, 0), (18, 0, 0, 0),
    (19, 1, 0, 1), (18, 1, 0, 0),
)
FINEST = 15
UNIT = 0.38196601125010500003
"""Distance of two base cells' centres on a face whose centre touches the unit sphere."""
TURN = float(np.arcsin(np.sqrt(3 / 28)))
"""Angle by which the lattices of odd levels are turned."""
DIGITS = {(0, 0): 0, (-1, -1): 1, (0, 1): 2, (-1, 0): 3, (1, 0): 4, (0, -1): 5, (1, 1): 6}
"""Digit of a step along the axes i and j, which are 120 degrees apart."""
AROUND = (1, 5, 4, 6, 2, 3)
"""Digits in anticlockwise order, 60 degrees apart."""


def face_axes() -> np.ndarray:
    """For each face three unit vectors: its centre, its first axis and the direction 90 degrees anticlockwise of that."""
    out = []
    for lat, lon, az in FACES:
        centre = np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        north = np.array([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)])
        east = np.array([-np.sin(lon), np.cos(lon), 0.0])
        out.append([centre, np.cos(az) * north + np.sin(az) * east, np.sin(az) * north - np.cos(az) * east])
    return np.array(out)


def _on_sphere(axes: np.ndarray, i: float, j: float, k: float) -> np.ndarray:
    """The point of the sphere behind a place of a face's lattice of base cells."""
    x, y = (i - k) - (j - k) / 2, (j - k) * np.sqrt(0.75)
    p = axes[0] + UNIT * (x * axes[1] + y * axes[2])
    return p / np.linalg.norm(p)


def _angle(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Angle from direction ``a`` to ``b`` in degrees, anticlockwise around the outward normal ``at``."""
    return float(np.degrees(np.arctan2(at @ np.cross(a, b), a @ b - (a @ at) * (b @ at))))


def _turned(digit: int, times: int) -> int:
    return AROUND[(AROUND.index(digit) + times) % 6] if digit else 0


def _pentagon_turns(corner: int, steps: int) -> tuple[int, ...]:
    """By leading digit, how far all digits of a pentagon's descendant turn to reach its home face's directions.

    The direction of digit 1 is missing. On a face that has the pentagon at its ``corner`` 0, 1 or 2 the cells are around
    digit 3, 5 or 6. Those that fall into the missing direction belong to the neighbour on that side. Then
    every face between this one and the home face turns them on, past the missing direction.
    """
    cycle = [3, 5, 4, 6, 2]
    rounds = (steps - cycle.index((3, 5, 6)[corner])) % 5
    turns = []
    for lead in range(8):
        total = 0
        if 0 < lead < 7:
            if lead == 1:
                total = -1 if corner == 1 else 1
            for _ in range(rounds):
                total += 1
                if _turned(lead, total) == 1:
                    total += 1
        turns.append(total % 6)
    return tuple(turns)


@cache
def base_tables() -> tuple[list[int], list[int], list[int]]:
    """By face and place (27 f + 9 i + 3 j + k): the base cell and the number of its pattern; then, by pattern and
    leading digit (8 p + d), the sixths of a turn that lead from the face's directions to those of the cell's home face."""
    axes = face_axes()
    centres = np.array([_on_sphere(axes[f], i, j, k) for f, i, j, k in HOMES])
    cells, patterns, known = [], [], {}
    for f in range(20):
        for i, j, k in np.ndindex(3, 3, 3):
            place = (i, j, k)
            cell = int(np.argmax(centres @ _on_sphere(axes[f], *place)))
            home, at = axes[HOMES[cell][0]], centres[cell]
            if HOMES[cell][1] == 2:
                steps = round(_angle(at, home[0], axes[f][0]) / 72) % 5
                turns = _pentagon_turns(int(np.argmax(np.array(place) - min(place))), steps)
            else:
                own = _on_sphere(axes[f], i + 0.01, j, k) - _on_sphere(axes[f], i, j, k)
                theirs = _on_sphere(home, *np.add(HOMES[cell][1:], (0.01, 0, 0))) - at
                turns = (round(_angle(at, theirs, own) / 60) % 6,) * 8
            cells.append(cell)
            patterns.append(known.setdefault(turns, len(known)))
    return cells, patterns, [t for turns in known for t in turns]


def _from(table: list, at: Column) -> Column:
    """The entry of a fixed table, which Spark folds to one literal."""
    return F.get(F.expr(f"array({', '.join(f'{x!r}D' if isinstance(x, float) else str(x) for x in table)})"), at.cast("int"))


def with_sphere_cell(df: DataFrame, level: int, name: str = "cell", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with the number of the cell of ``level`` (0 to 15) that holds the point; degrees in, a long out.

    A null, infinite or NaN coordinate gives null. All in compiled expressions, without a shuffle; a column called
    ``name`` is replaced.
    """
    if not 0 <= level <= FINEST:
        raise ValueError(f"level must be 0 to {FINEST}: {level}")
    axes = face_axes()
    p = [f"__{c}" for c in "xyz"]

    def dot(vector: list[Column] | np.ndarray) -> Column:
        x, y, z = (F.lit(float(v)) if isinstance(v, float) else v for v in vector)
        return F.col(p[0]) * x + F.col(p[1]) * y + F.col(p[2]) * z

    la, lo = (F.radians(F.when(F.abs(F.col(c).cast("double")) < 1e6, F.col(c).cast("double"))) for c in (lat, lon))
    out = df.withColumns({p[0]: F.cos(la) * F.cos(lo), p[1]: F.cos(la) * F.sin(lo), p[2]: F.sin(la)})
    nearest = F.greatest(*[F.struct(dot(a[0]).alias("near"), F.lit(f).alias("face")) for f, a in enumerate(axes)])
    out = out.withColumn("__face", nearest["face"])
    out = out.withColumns({f"__{c}": dot([_from(axes[:, n, d].tolist(), F.col("__face")) for d in range(3)]) for n, c in enumerate("nuv")})
    turn, scale = TURN * (level % 2), 7 ** (level / 2) / UNIT
    u, v = F.col("__u") / F.col("__n") * scale, F.col("__v") / F.col("__n") * scale
    out = out.withColumns({"__u": u * float(np.cos(turn)) + v * float(np.sin(turn)), "__v": v * float(np.cos(turn)) - u * float(np.sin(turn))})
    # the nearest centre: three axes 60 degrees apart, of which the least certain follows from the others
    out = out.withColumn("__b", F.col("__v") / float(np.sqrt(0.75)))
    out = out.withColumn("__a", F.col("__u") + F.col("__b") / 2)
    out = out.withColumns({"__ra": F.rint("__a"), "__rb": F.rint("__b"), "__rc": F.rint(F.col("__a") - F.col("__b"))})
    off_a, off_b = F.abs(F.col("__ra") - F.col("__a")), F.abs(F.col("__rb") - F.col("__b"))
    off_c = F.abs(F.col("__rc") - (F.col("__a") - F.col("__b")))
    a = F.when((off_a > off_b) & (off_a > off_c), F.col("__rb") + F.col("__rc")).otherwise(F.col("__ra"))
    b = F.when((off_b >= off_a) & (off_b > off_c), F.col("__ra") - F.col("__rc")).otherwise(F.col("__rb"))
    out = out.withColumns({f"__a{level}": a.cast("long"), f"__b{level}": b.cast("long")})
    steps = [DIGITS.get((x, y), 7) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    for r in range(level, 0, -1):
        a, b = F.col(f"__a{r}"), F.col(f"__b{r}")
        up = (3 * a - b, a + 2 * b) if r % 2 else (2 * a + b, 3 * b - a)
        out = out.withColumns({f"__{c}{r - 1}": F.floor(x / 7.0 + 0.5) for c, x in zip("ab", up, strict=True)})
        up_a, up_b = F.col(f"__a{r - 1}"), F.col(f"__b{r - 1}")
        down = (2 * up_a + up_b, 3 * up_b - up_a) if r % 2 else (3 * up_a - up_b, up_a + 2 * up_b)
        out = out.withColumn(f"__d{r}", _from(steps, (a - down[0] + 1) * 3 + b - down[1] + 1)).drop(f"__a{r}", f"__b{r}")
    a, b = F.col("__a0"), F.col("__b0")
    low = F.least(a, b, F.lit(0))
    cells, patterns, turns = base_tables()
    out = out.withColumn("__place", (27 * F.col("__face") + 9 * (a - low) + 3 * (b - low) - low).cast("int"))
    digits = [F.col(f"__d{r}") for r in range(1, level + 1)]
    lead = F.coalesce(*[F.when(d > 0, d) for d in digits], F.lit(0))
    out = out.withColumn("__turn", _from(turns, 8 * _from(patterns, F.col("__place")) + lead))
    turned = [_turned(d, t) if d < 7 else 7 for t in range(6) for d in range(8)]
    number = F.shiftleft(_from(cells, F.col("__place")).cast("long"), 45)
    for r, d in enumerate(digits, 1):
        number = number + F.shiftleft(_from(turned, 8 * F.col("__turn") + d).cast("long"), 3 * (FINEST - r))
    number = number + F.lit((1 << 59) + (level << 52) + (1 << 3 * (FINEST - level)) - 1)
    return out.select(*[c for c in df.columns if c != name], number.alias(name))


def level_of(cell: Column) -> Column:
    """The level of a cell."""
    return F.shiftright(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def parent_cell(cell: Column, level: int) -> Column:
    """The cell of a coarser ``level`` whose descendant ``cell`` is, or itself; null where the cell is coarser."""
    rest = (1 << 3 * (FINEST - level)) - 1
    bare = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit((level << 52) + rest))
    return F.when(level_of(cell) >= level, bare)


def cell_text(cell: Column) -> Column:
    """A cell's usual name: its number in hexadecimal digits."""
    return F.lower(F.hex(cell))
