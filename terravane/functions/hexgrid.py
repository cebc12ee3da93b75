"""The public hexagonal grid on an icosahedron (aperture 7, 122 base cells, resolutions 0 to 15), with numpy.

Only the orientation of the icosahedron is given; base cells, their home faces and the turns between faces are derived
from it. Points are projected gnomonically on the nearest face, rounded to the lattice of the resolution, and carried up
through the resolutions; each step up leaves a digit. Faces are joined by unfolding over their common edge.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Centres of the faces (latitude, longitude) and azimuths of their first axis, in radians.
FACES = np.array([
    [0.803582649718989942, 1.248397419617396099, 5.619958268523939882], [1.307747883455638156, 2.536945009877921159, 5.760339081714187279],
    [1.054751253523952054, -1.347517358900396623, 0.780213654393430055], [0.600191595538186799, -0.450603909469755746, 0.430469363979999913],
    [0.491715428198773866, 0.401988202911306943, 6.130269123335111400], [0.172745327415618701, 1.678146885280433686, 2.692877706530642877],
    [0.605929321571350690, 2.953923329812411617, 2.982963003477243874], [0.427370518328979641, -1.888876200336285401, 3.532912002790141181],
    [-0.079066118549212831, -0.733429513380867741, 3.494305004259568154], [-0.230961644455383637, 0.506495587332349035, 3.003214169499538391],
    [0.079066118549212831, 2.408163140208925497, 5.930472956509811562], [0.230961644455383637, -2.635097066257444203, 0.138378484090254847],
    [-0.172745327415618701, -1.463445768309359553, 0.448714947059150361], [-0.605929321571350690, -0.187669323777381622, 0.158629650112549365],
    [-0.427370518328979641, 1.252716453253507838, 5.891865957979238535], [-0.600191595538186799, 2.690988744120037492, 2.711123289609793325],
    [-0.491715428198773866, -2.739604450678486295, 3.294508837434268316], [-0.803582649718989942, -1.893195233972397139, 3.804819692245439833],
    [-1.307747883455638156, -0.604647643711872080, 3.664438879055192436], [-1.054751253523952054, 1.794075294689396615, 2.361378999196363184],
])
# Length of a base cell's step on a face's plane, turn of odd resolutions, mean radius in metres.
UNIT, TURN, EARTH_M = 0.38196601125010500003, 0.333473172251832115336090755351601070065900389, 6_371_007.180918475
SQRT7, SIN60 = np.sqrt(7.0), np.sqrt(3.0) / 2
#: Lattice steps (i, j) of the digits 0 to 6, and digits turned by 60 degrees against the clock.
STEPS = np.array([[0, 0], [-1, -1], [0, 1], [-1, 0], [1, 0], [0, -1], [1, 1]])
_LEFT = np.array([0, 5, 3, 1, 6, 4, 2])
_TURNS = [np.arange(7)]
for _ in range(5):
    _TURNS.append(_LEFT[_TURNS[-1]])
TURNS = np.array(_TURNS)
_DIGITS = np.zeros((3, 3), np.int64)  # by step, negative ones from the end
_DIGITS[STEPS[:, 0], STEPS[:, 1]] = np.arange(7)
#: Faces from which a pentagon's first digit turns with the clock, by its number.
CLOCKWISE = {14: (2, 6), 24: (1, 5), 38: (3, 7), 49: (0, 9), 58: (4, 8), 63: (11, 15), 72: (12, 16), 83: (10, 19), 97: (13, 17), 107: (14, 18)}


def _vector(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


_CENTRES = _vector(FACES[:, 0], FACES[:, 1])


def _plane(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lattice coordinates on the plane: axes i at 0 and j at 120 degrees."""
    return i - j / 2, j * SIN60


def _project(face: np.ndarray, x: np.ndarray, y: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude (radians) of plane coordinates of a resolution on a face."""
    r, theta = np.hypot(x, y), np.arctan2(y, x)
    r = np.arctan(r / SQRT7**res * UNIT)
    azimuth = FACES[face, 2] - theta - (TURN if res % 2 else 0.0)
    lat0, lon0 = FACES[face, 0], FACES[face, 1]
    sin_lat = np.clip(np.sin(lat0) * np.cos(r) + np.cos(lat0) * np.sin(r) * np.cos(azimuth), -1, 1)
    lon = lon0 + np.arctan2(np.sin(azimuth) * np.sin(r) * np.cos(lat0), np.cos(r) - np.sin(lat0) * sin_lat)
    return np.arcsin(sin_lat), (lon + np.pi) % (2 * np.pi) - np.pi


def _locate(lat: np.ndarray, lon: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest face and plane coordinates of points (radians)."""
    p = _vector(lat, lon)
    face = (p @ _CENTRES.T).argmax(1)
    lat0, lon0, axis = FACES[face].T
    cos_r = np.clip((p * _CENTRES[face]).sum(1), -1, 1)
    r = np.arccos(cos_r)
    azimuth = np.arctan2(np.cos(lat) * np.sin(lon - lon0), np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lon - lon0))
    theta = axis - azimuth - (TURN if res % 2 else 0.0)
    r = np.where(r < 1e-16, 0.0, np.tan(r) / UNIT * SQRT7**res)
    return face, r * np.cos(theta), r * np.sin(theta)


def _round(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest lattice point."""
    r = y / SIN60
    q = x - r / 2
    s = -q - r
    a, b, c = np.rint(q), np.rint(r), np.rint(s)
    da, db, dc = np.abs(a - q), np.abs(b - r), np.abs(c - s)
    a = np.where((da > db) & (da > dc), -b - c, a)
    b = np.where((da > db) & (da > dc), b, np.where(db > dc, -a - c, b))
    return (a + b).astype(np.int64), b.astype(np.int64)


def _up(i: np.ndarray, j: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    a, b = (3 * i - j, i + 2 * j) if odd else (2 * i + j, 3 * j - i)
    near = lambda v: np.floor_divide(2 * v + 7, 14)  # noqa: E731 - rounded sevenths
    return near(a), near(b)


def _down(i: np.ndarray, j: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    return (2 * i + j, 3 * j - i) if odd else (3 * i - j, i + 2 * j)


def _beyond(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Which edge of the face's triangle a lattice point lies beyond: -1 none, 0 over i-j, 1 over j-k, 2 over k-i."""
    low = np.minimum(np.minimum(i, j), 0)
    a, b, c = i - low, j - low, -low
    out = np.where(c == 0, 0, np.where(b > 0, 1, 2))
    return np.where(a + b + c > size, out, -1)


_CORNERS = np.array([[2, 0], [0, 2], [-2, -2]])  # the triangle's corners on axes i, j and k


class _Net:
    """Faces joined by unfolding, and the base cells."""

    def __init__(self) -> None:
        x, y = _plane(_CORNERS[:, 0].astype(float), _CORNERS[:, 1].astype(float))
        corner = np.array([_vector(*_project(np.full(3, f), x, y, 0)) for f in range(20)])
        edge_of = [(0, 1), (1, 2), (2, 0)]
        self.neighbour = np.zeros((20, 3), int)
        self.turn = np.zeros((20, 3), int)
        self.shift = np.zeros((20, 3, 2), int)
        same = lambda p, q: np.linalg.norm(p - q) < 1e-6
        for f in range(20):
            for e, (a, b) in enumerate(edge_of):
                for g in range(20):
                    ends = [[k for k in range(3) if same(corner[g, k], corner[f, v])] for v in (a, b)]
                    if g != f and all(ends):
                        u, v = ends[0][0], ends[1][0]
                        self.neighbour[f, e] = g
                        for n in range(6):
                            pa, pb = (_turned(_CORNERS[k], n) for k in (a, b))
                            if (pb - pa == _CORNERS[v] - _CORNERS[u]).all():
                                self.turn[f, e], self.shift[f, e] = n, _CORNERS[u] - pa
        self._number_cells(corner)

    def _number_cells(self, corner: np.ndarray) -> None:
        places: dict[tuple, list] = {}
        inside = [(0, 0), *[tuple(s) for s in STEPS[1:]], *[tuple(c) for c in _CORNERS]]
        for f in range(20):
            for i, j in inside:
                x, y = _plane(np.array([float(i)]), np.array([float(j)]))
                p = _vector(*_project(np.array([f]), x, y, 0))[0]
                places.setdefault(tuple(np.round(p, 6) + 0.0), []).append((f, (i, j)))
        # Base cells are numbered from north to south.
        ordered = sorted(places.items(), key=lambda item: -item[0][2])
        self.cells: list[tuple[int, tuple[int, int]]] = []
        self.pentagon = np.zeros(len(ordered), bool)
        self.number: dict[tuple[int, tuple[int, int]], int] = {}
        for n, (_, held) in enumerate(ordered):
            self.cells.append(min(held, key=_home_rank))
            self.pentagon[n] = held[0][1] in [tuple(c) for c in _CORNERS]
            for place in held:
                self.number[place] = n
        self.turns: dict[tuple[int, tuple[int, int]], int] = {}
        for f in range(20):
            for i in range(-2, 3):
                for j in range(-2, 3):
                    low = min(i, j, 0)
                    if max(i - low, j - low, -low) <= 2:
                        self._resolve(f, (i, j))

        self.numbers, self.turn_table = np.full((20, 5, 5), -1), np.zeros((20, 5, 5), np.int64)
        for (f, (a, b)), n in self.number.items():
            self.numbers[f, a + 2, b + 2] = n
            self.turn_table[f, a + 2, b + 2] = self.turns.get((f, (a, b)), 0)
        self.homes = np.array([[f, i, j] for f, (i, j) in self.cells])

    def _resolve(self, face: int, at: tuple[int, int]) -> None:
        """Number and turn to the home face of the base cell at a place, also one beyond an edge."""
        g, here, turn = face, at, 0
        edge = int(_beyond(np.array(at[0]), np.array(at[1]), 2))
        if edge >= 0:
            g, turn = int(self.neighbour[face, edge]), int(self.turn[face, edge])
            here = tuple((_turned(np.array(at), turn) + self.shift[face, edge]).tolist())
        n = self.number.get((g, here))
        if n is None:
            return
        if self.pentagon[n]:
            turn = self._pentagon_turn(face, at)
        elif self.cells[n][0] != g:
            e = next(e for e in range(3) if self.neighbour[g, e] == self.cells[n][0])
            turn += int(self.turn[g, e])
        self.number[face, at] = n
        self.turns[face, at] = turn % 6

    @staticmethod
    def _pentagon_turn(face: int, at: tuple[int, int]) -> int:
        corner = [tuple(c) for c in _CORNERS.tolist()].index(at)
        if 5 <= face < 15:
            return 0 if corner == 0 else 3
        return (face if face < 5 else 19 - face) if corner == 0 else 1 if corner == 1 else 0


def _turned(p: np.ndarray, n: int) -> np.ndarray:
    """Lattice coordinates turned n times by 60 degrees against the clock."""
    i, j = p[..., 0], p[..., 1]
    for _ in range(n):
        i, j = i - j, i
    return np.stack([i, j], -1)


def _home_rank(place: tuple[int, tuple[int, int]]) -> tuple[int, int]:
    """The face whose frame a base cell keeps ranks first: fixed by where the cell lies on the faces that share it."""
    face, at = place
    band = 0 if face < 5 else 1 if face < 10 else 2 if face < 15 else 3
    kept = {0: [(1, 1), (-1, 0), (2, 0)], 1: [(0, -1), (2, 0)], 2: [(1, 1), (2, 0)], 3: [(-1, 0), (0, -1), (2, 0)]}[band]
    return (0 if at in kept or at in ((0, 0), (1, 0), (0, 1), (-1, -1)) else 1, face if band < 3 else -face)


@lru_cache(maxsize=1)
def net() -> _Net:
    return _Net()


def _leading(digits: np.ndarray) -> np.ndarray:
    """First digit of each row that is not 0, or 0."""
    some = digits != 0
    return np.where(some.any(1), digits[np.arange(len(digits)), some.argmax(1)] if digits.shape[1] else 0, 0)


def encode(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    """Cells (uint64) of points in degrees; 0 for positions that are missing or not finite."""
    lat, lon = np.atleast_1d(np.asarray(lat, float)), np.atleast_1d(np.asarray(lon, float))
    out = np.zeros(len(lat), np.uint64)
    fine = np.isfinite(lat) & np.isfinite(lon)
    if fine.any():
        out[fine] = _encode(np.radians(lat[fine]), np.radians(lon[fine]), res)
    return out


def _encode(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    if not 0 <= res <= 15:
        raise ValueError("resolutions are 0 to 15")
    grid = net()
    face, x, y = _locate(lat, lon, res)
    i, j = _round(x, y)
    digits = np.zeros((len(lat), res), np.int64)
    for r in range(res, 0, -1):
        up_i, up_j = _up(i, j, r % 2 == 1)
        down_i, down_j = _down(up_i, up_j, r % 2 == 1)
        digits[:, r - 1] = _DIGITS[i - down_i, j - down_j]
        i, j = up_i, up_j
    base, turn = grid.numbers[face, i + 2, j + 2], grid.turn_table[face, i + 2, j + 2]
    pent = grid.pentagon[base]
    hexa = ~pent
    digits[hexa] = TURNS[turn[hexa][:, None], digits[hexa]]
    rows = np.flatnonzero(pent & digits.any(1)) if res else np.zeros(0, np.int64)
    if len(rows):
        # A pentagon lacks the sector of digit 1: cells that would lie in it are turned out of it, at first and after every turn.
        d, turns = digits[rows], turn[rows]
        lost = _leading(d) == 1
        clockwise = np.array([f in CLOCKWISE.get(b, ()) for f, b in zip(face[rows][lost].tolist(), base[rows][lost].tolist())], bool)
        d[lost] = TURNS[np.where(clockwise, 5, 1)[:, None], d[lost]]
        for n in range(int(turns.max())):
            d = np.where((turns > n)[:, None], TURNS[1, d], d)
            d = np.where(((turns > n) & (_leading(d) == 1))[:, None], TURNS[1, d], d)
        digits[rows] = d
    return _pack(base, digits, res)


def _pack(base: np.ndarray, digits: np.ndarray, res: int) -> np.ndarray:
    cell = np.full(len(base), (1 << 59) | (res << 52), np.uint64) | (base.astype(np.uint64) << np.uint64(45))
    for r in range(1, 16):
        digit = digits[:, r - 1].astype(np.uint64) if r <= res else np.uint64(7)
        cell |= digit << np.uint64(3 * (15 - r))
    return cell


def resolution(cell: int) -> int:
    return (cell >> 52) & 15


def valid(cell: int) -> bool:
    """Mode, base cell and digits of a cell's number."""
    res, base = resolution(cell), (cell >> 45) & 127
    digits = [(cell >> (3 * (15 - r))) & 7 for r in range(1, 16)]
    fine = cell >> 59 == 1 and (cell >> 56) & 7 == 0 and base < 122 and all(d < 7 for d in digits[:res]) and all(d == 7 for d in digits[res:])
    return fine and not (net().pentagon[base] and next((d for d in digits[:res] if d), 0) == 1)


def _placed(cell: int) -> tuple[int, int, int, int]:
    """Face, lattice coordinates and resolution of a cell's centre."""
    grid = net()
    res, base = resolution(cell), (cell >> 45) & 127
    digits = [(cell >> (3 * (15 - r))) & 7 for r in range(1, res + 1)]
    first = next((d for d in digits if d), 0)
    pent = bool(grid.pentagon[base])
    if pent and first == 5:
        digits = [int(TURNS[5, d]) for d in digits]
    face, (i, j) = grid.cells[base]
    for r, d in enumerate(digits, 1):
        i, j = _down(i, j, r % 2 == 1)
        i, j = i + int(STEPS[d, 0]), j + int(STEPS[d, 1])
    face, i, j = _folded(face, i, j, res, pent and first == 4, pent)
    return face, i, j, res


def _folded(face: int, i: int, j: int, res: int, past_gap: bool, pent: bool) -> tuple[int, int, int]:
    """The face on which a lattice point lies, moving over edges as often as needed."""
    grid = net()
    odd = res % 2 == 1
    a, b, size = i, j, 2 * 7 ** ((res + 1) // 2)
    if odd:
        a, b = _down(a, b, False)
    moved = False
    for _ in range(4 if pent else 1):
        edge = int(_beyond(np.array(a), np.array(b), size))
        if edge < 0:
            break
        if past_gap and edge == 2:
            # The pentagon lacks the sector of axis k: what lies beyond turns around its centre.
            p = _turned(np.array([a - size, b]), 5) + np.array([size, 0])
            a, b = int(p[0]), int(p[1])
        p = _turned(np.array([a, b]), int(grid.turn[face, edge])) + grid.shift[face, edge] * (size // 2)
        face, a, b, moved, past_gap = int(grid.neighbour[face, edge]), int(p[0]), int(p[1]), True, False
    if not moved:
        return face, i, j
    if odd:
        up = _up(np.array(a), np.array(b), False)
        a, b = int(up[0]), int(up[1])
    return face, a, b


def centre(cell: int) -> tuple[float, float]:
    """Latitude and longitude (degrees) of a cell's centre."""
    face, i, j, res = _placed(int(cell))
    x, y = _plane(np.array([float(i)]), np.array([float(j)]))
    lat, lon = _project(np.array([face]), x, y, res)
    return float(np.degrees(lat[0])), float(np.degrees(lon[0]))


def _placed_many(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Face and lattice coordinates of the centres of cells of one resolution."""
    grid, res = net(), resolution(int(cells[0]))
    base = ((cells >> np.uint64(45)) & np.uint64(127)).astype(np.int64)
    digits = np.stack([((cells >> np.uint64(3 * (15 - r))) & np.uint64(7)).astype(np.int64) for r in range(1, res + 1)], 1) if res else np.zeros((len(cells), 0), np.int64)
    pent = grid.pentagon[base]
    first = _leading(digits)
    digits = np.where((pent & (first == 5))[:, None], TURNS[5][digits], digits)
    past_gap = pent & (first == 4)
    face, i, j = grid.homes[base].T.copy()
    for r in range(1, res + 1):
        i, j = _down(i, j, r % 2 == 1)
        i, j = i + STEPS[digits[:, r - 1], 0], j + STEPS[digits[:, r - 1], 1]
    odd, size = res % 2 == 1, 2 * 7 ** ((res + 1) // 2)
    a, b = _down(i, j, False) if odd else (i, j)
    moved = np.zeros(len(cells), bool)
    for turn in range(4):
        edge = _beyond(a, b, size)
        over = np.flatnonzero((edge >= 0) & (pent if turn else True))
        if not len(over):
            break
        f, e, p, q = face[over], edge[over], a[over], b[over]
        gap = past_gap[over] & (e == 2)
        # Five sixths of a turn around the pentagon's centre, past the sector that it lacks.
        p, q = np.where(gap, q + size, p), np.where(gap, q - (p - size), q)
        for n in range(1, 6):
            more = grid.turn[f, e] >= n
            p, q = np.where(more, p - q, p), np.where(more, p, q)
        a[over], b[over] = p + grid.shift[f, e, 0] * (size // 2), q + grid.shift[f, e, 1] * (size // 2)
        face[over] = grid.neighbour[f, e]
        past_gap[over] = False
        moved[over] = True
    if odd:
        up_i, up_j = _up(a, b, False)
        a, b = np.where(moved, up_i, i), np.where(moved, up_j, j)
    return face, a, b


def centres(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes (degrees) of cells of one resolution."""
    cells = np.asarray(cells, np.uint64)
    if not len(cells):
        return np.zeros(0), np.zeros(0)
    face, i, j = _placed_many(cells)
    lat, lon = _project(face, *_plane(i.astype(float), j.astype(float)), resolution(int(cells[0])))
    return np.degrees(lat), np.degrees(lon)


@lru_cache(maxsize=1)
def _pentagon_vectors() -> np.ndarray:
    return np.array([_vector(*(np.radians(v) for v in centre(int(_pack(np.array([n]), np.zeros((1, 0), np.int64), 0)[0])))) for n in np.flatnonzero(net().pentagon)])


def _near_pentagons(cells: np.ndarray) -> np.ndarray:
    """Cells within some steps of a pentagon, where lattices do not go on as planes."""
    lat, lon = (np.radians(v) for v in centres(cells))
    reach = np.cos(min(np.pi, 6 * edge_m(resolution(int(cells[0]))) / EARTH_M))
    return (_vector(lat, lon) @ _pentagon_vectors().T).max(1) > reach


def neighbours_of(cells: np.ndarray) -> np.ndarray:
    """Six columns of neighbours of cells of one resolution (a pentagon's five, one of them twice).

    A neighbour beyond the edge of a face is looked up where the face's plane goes on, which is off its centre by far
    less than its size; only cells close to pentagons are looked up one by one.
    """
    cells = np.asarray(cells, np.uint64)
    out = np.zeros((len(cells), 6), np.uint64)
    if not len(cells):
        return out
    slow = _near_pentagons(cells)
    for k in np.flatnonzero(slow):
        near = neighbours(int(cells[k]))
        out[k] = (list(near) + [near[-1]] * 6)[:6]
    if not slow.all():
        res = resolution(int(cells[0]))
        face, i, j = _placed_many(cells[~slow])
        found = []
        for di, dj in STEPS[1:]:
            lat, lon = _project(face, *_plane((i + di).astype(float), (j + dj).astype(float)), res)
            found.append(_encode(lat, lon, res))
        out[~slow] = np.stack(found, 1)
    return out


def _inside(x: float, y: float, res: int) -> tuple[int, np.ndarray]:
    """Edge of the triangle that a plane point lies beyond (-1: none), and its distances over the three edges."""
    angle = TURN if res % 2 else 0.0
    size = SQRT7**res
    # Outward normals of the edges opposite to corners k, i and j; the in-radius is 1 base step.
    over = np.array([x * np.cos(t - angle) + y * np.sin(t - angle) for t in np.radians([60.0, 180.0, 300.0])]) - size
    return (int(over.argmax()) if over.max() > 1e-9 * size else -1), over


def _corner_point(face: int, x: float, y: float, res: int) -> tuple[float, float, int]:
    """Position of a plane point, unfolded to the next face if it lies beyond an edge, and the edge."""
    edge, _ = _inside(x, y, res)
    if edge >= 0:
        grid, angle = net(), TURN if res % 2 else 0.0
        z = complex(x, y) * np.exp(1j * angle) / SQRT7**res
        sx, sy = _plane(*grid.shift[face, edge].astype(float))
        z = z * np.exp(1j * np.pi / 3 * grid.turn[face, edge]) + complex(sx, sy)
        z *= SQRT7**res * np.exp(-1j * angle)
        face, x, y = int(grid.neighbour[face, edge]), z.real, z.imag
    lat, lon = _project(np.array([face]), np.array([x]), np.array([y]), res)
    return float(lat[0]), float(lon[0]), edge


def boundary(cell: int) -> np.ndarray:
    """Corners (lat, lon in degrees) of a cell against the clock; where an edge crosses faces, the crossing is one too."""
    cell = int(cell)
    grid = net()
    base = (cell >> 45) & 127
    digits = [(cell >> (3 * (15 - r))) & 7 for r in range(1, resolution(cell) + 1)]
    if grid.pentagon[base] and not any(digits):
        return _pentagon_boundary(base, resolution(cell))
    face, i, j, res = _placed(cell)
    cx, cy = (float(v) for v in _plane(float(i), float(j)))
    angles = np.radians(30 + 60 * np.arange(6))
    xs, ys = cx + np.cos(angles) / np.sqrt(3), cy + np.sin(angles) / np.sqrt(3)
    out = []
    for k in range(6):
        lat, lon, edge = _corner_point(face, xs[k], ys[k], res)
        out.append((lat, lon))
        n = (k + 1) % 6
        other, over_n = _inside(xs[n], ys[n], res)
        if res % 2 and edge != other:
            e = edge if edge >= 0 else other
            over_k = _inside(xs[k], ys[k], res)[1][e]
            share = over_k / (over_k - over_n[e]) if over_k != over_n[e] else 0.0
            if 1e-9 < share < 1 - 1e-9:
                x, y = xs[k] + share * (xs[n] - xs[k]), ys[k] + share * (ys[n] - ys[k])
                lat, lon = _project(np.array([face]), np.array([x]), np.array([y]), res)
                out.append((float(lat[0]), float(lon[0])))
    return np.degrees(np.array(out))


def _pentagon_boundary(base: int, res: int) -> np.ndarray:
    grid = net()
    points = []
    turn = TURN if res % 2 else 0.0
    for face in range(20):
        for corner in _CORNERS.tolist():
            if grid.number[face, tuple(corner)] != base:
                continue
            x, y = _plane(float(corner[0]), float(corner[1]))
            z = complex(x, y) * SQRT7**res * np.exp(-1j * turn)
            inward = np.angle(-z)
            for a in np.radians(30 + 60 * np.arange(6)):
                off = (a - inward + np.pi) % (2 * np.pi) - np.pi
                if -np.pi / 6 - 1e-9 <= off < np.pi / 6 - 1e-9:
                    p = z + np.exp(1j * a) / np.sqrt(3)
                    lat, lon = _project(np.array([face]), np.array([p.real]), np.array([p.imag]), res)
                    points.append((float(lat[0]), float(lon[0])))
    lat, lon = np.array(points).T
    lat0, lon0 = np.radians(centre(int(_pack(np.array([base]), np.zeros((1, res), np.int64), res)[0])))
    azimuth = np.arctan2(np.cos(lat) * np.sin(lon - lon0), np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lon - lon0))
    order = np.argsort(-azimuth)
    return np.degrees(np.stack([lat[order], lon[order]], 1))


@lru_cache(maxsize=200_000)
def neighbours(cell: int) -> tuple[int, ...]:
    """Cells that share an edge with this one: found a little beyond the middle of each edge."""
    res = resolution(cell)
    edge = np.radians(boundary(cell))
    lat0, lon0 = np.radians(centre(cell))
    c, p = _vector(np.array(lat0), np.array(lon0)), _vector(edge[:, 0], edge[:, 1])
    middle = p + np.roll(p, -1, 0)
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    beyond = c + 1.3 * (middle - c)
    beyond /= np.linalg.norm(beyond, axis=1)[:, None]
    found = _encode(np.arcsin(beyond[:, 2]), np.arctan2(beyond[:, 1], beyond[:, 0]), res)
    return tuple(dict.fromkeys(int(n) for n in found if int(n) != cell))


def ring(cell: int, k: int) -> set[int]:
    """Cells at most ``k`` steps away, this one included."""
    seen, front = {cell}, [cell]
    for _ in range(k):
        found = set(neighbours_of(np.array(front, np.uint64)).ravel().tolist())
        front = list(found - seen)
        seen |= found
    return seen


def rings_of(cells: np.ndarray, k: int) -> list[set[int]]:
    """``ring`` of many cells of one resolution at once."""
    found = [{c} for c in cells.tolist()]
    owner, front = np.arange(len(cells)), np.asarray(cells, np.uint64)
    for _ in range(k):
        if not len(front):
            break
        near = neighbours_of(front)
        pairs = set(zip(np.repeat(owner, 6).tolist(), near.ravel().tolist()))
        fresh = [(o, c) for o, c in pairs if c not in found[o]]
        for o, c in fresh:
            found[o].add(c)
        owner, front = np.array([o for o, _ in fresh], np.int64), np.array([c for _, c in fresh], np.uint64)
    return found


def edge_m(res: int) -> float:
    """Mean length of a cell's edge in metres, from the mean area of a hexagon."""
    area = 4 * np.pi * EARTH_M**2 / (2 + 120 * 7**res)
    return float(np.sqrt(2 * area / (3 * np.sqrt(3))))
