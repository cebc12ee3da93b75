"""Japanese grid square codes (JIS X 0410) as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells of a level along a side of the level above it, for latitude and longitude.
SPLITS = {2: (8, 8), 3: (10, 10), 4: (2, 2), 5: (2, 2), 6: (2, 2)}


def japan_mesh(lat: Column, lon: Column, level: int = 6) -> Column:
    """The code of the square at ``level`` 1 to 6 that holds a point; null for null positions."""
    if not 1 <= level <= 6:
        raise ValueError("mesh levels are 1 to 6")
    y, x = F.floor(lat * 1.5), F.floor(lon - 100)
    two = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
    code = F.concat(two(y % 100), two(x))
    rest_y, rest_x = lat - y * (2.0 / 3.0), lon - (x + 100)
    height, width = 2.0 / 3.0, 1.0
    for depth in range(2, level + 1):
        rows, columns = SPLITS[depth]
        height, width = height / rows, width / columns
        j, i = F.floor(rest_y / height), F.floor(rest_x / width)
        rest_y, rest_x = rest_y - j * height, rest_x - i * width
        digits = F.concat(j.cast("string"), i.cast("string")) if depth < 4 else (j * 2 + i + 1).cast("string")
        code = F.concat(code, digits)
    return code
