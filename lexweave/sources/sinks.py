"""Writers: localization files, catalogs, digests, reports. File names are chosen here, so the driver puts the
files in place: localization files from parts that tasks wrote, the others streamed one partition at a time in order."""

from __future__ import annotations

import json
import os
import re
import shutil
import struct
import textwrap
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.storage import fresh_path, mounted

#: The picture that the descriptor names.
PICTURE = "thumbnail.png"
BOM = "﻿"


def line_of(key: Column, version: Column, text: Column) -> Column:
    """One row of a localization file (O-16)."""
    mark = F.when(version >= 0, version.cast("string")).otherwise("")
    return F.concat(F.lit(" "), key, F.lit(":"), mark, F.lit(' "'), M.quote(text), F.lit('"'))


def output_path(file: Column, layer: Column, source: str, target: str, single: str | None = None) -> Column:
    """Where a row goes: its layer, the target language, and the source file's base name (O-17)."""
    base = F.regexp_replace(F.element_at(F.split(file, "/"), -1), rf"_l_{source}\.yml\z", "")
    name = F.lit(single) if single else base
    return F.concat(layer, F.lit(f"/localization/{target}/0_"), name, F.lit(f"_l_{target}.yml"))


def write_localization(rendered: DataFrame, out: str, source: str = "english", target: str = "korean", single: str | None = None) -> int:
    """Writes rendered rows (key, version, text, file, layer, line) as files; returns their number (O-16, O-17)."""
    path = output_path(F.col("file"), F.col("layer"), source, target, single)
    rows = rendered.select(path.alias("path"), line_of(F.col("key"), F.col("version"), F.col("text")).alias("value"), "file", "line")
    names = sorted(r["path"] for r in rows.select("path").distinct().collect())
    # tasks write the rows in parts, in order; the driver gets the names of the files and joins their parts
    spark, staged = rendered.sparkSession, fresh_path(rendered.sparkSession)
    at = spark.createDataFrame(list(enumerate(names)), "at int, path string")
    ordered = rows.join(F.broadcast(at), "path").select("at", "file", "line", "value").orderBy("at", "file", "line")
    ordered.select("at", "value").write.partitionBy("at").option("compression", "none").option("lineSep", "\n").text(staged)
    here = mounted(staged)

    def join(k: int) -> None:
        full = os.path.join(out, names[k])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(f"{BOM}l_{target}:\n".encode())
            for part in sorted((x for x in os.listdir(f"{here}/at={k}") if x.startswith("part-")), key=_part):
                with open(f"{here}/at={k}/{part}", "rb") as data:
                    shutil.copyfileobj(data, f, 1 << 24)
                os.remove(f"{here}/at={k}/{part}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(join, range(len(names))))
    shutil.rmtree(here)
    return len(names)


def _part(name: str) -> tuple[int, int]:
    """Task and number of a part that Spark wrote, in which parts follow each other."""
    found = re.match(r"part-(\d+)-.*?(?:[.-]c(\d+))?(?:\.|$)", name)
    return int(found[1]), int(found[2] or 0)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Units in order as version-1 JSON (O-18)."""
    # what is there stays until the new file is whole
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write('{\n  "version": 1,\n  "units": [')
        gap = "\n"
        for r in catalog.orderBy("pos").toLocalIterator():
            unit = json.dumps({k: r[k] for k in ("template", "korean", "rep", "class", "members")}, ensure_ascii=False, indent=2)
            f.write(gap + textwrap.indent(unit, "    "))
            gap = ",\n"
        f.write(("]" if gap == "\n" else "\n  ]") + "\n}\n")
    os.replace(f"{path}.new", path)


def write_digest(keys: DataFrame, path: str, sources: list[str]) -> None:
    """Sorted ``layer<TAB>key`` lines under a header (O-19)."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write("# layer\tkey\n")
        f.writelines(f"# source: {s}\n" for s in sources)
        f.writelines(f"{r['layer']}\t{r['key']}\n" for r in keys.orderBy("key", "layer").toLocalIterator())


def write_json(value: object, path: str) -> None:
    """A report as JSON (O-20)."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def write_metadata(out: str, name: str, ident: str, version: str, game_version: str, language: str = "korean", needs: tuple[str, str, str] | None = None) -> None:
    """The pack's descriptor with a byte order mark, tab-indented (O-21). ``needs``: id, name and version of the mod it translates."""
    tied = [{"rel_type": "dependency", "id": needs[0], "display_name": needs[1], "resource_type": "mod", "version": needs[2]}] if needs else []
    folder = os.path.join(out, ".metadata")
    os.makedirs(folder, exist_ok=True)
    about = {"name": name, "id": ident, "version": version, "supported_game_version": game_version, "short_description": f"{name} ({language})", "tags": ["Localization"]}
    about |= ({"relationships": tied} if tied else {}) | {"picture": PICTURE, "game_custom_data": {}}
    with open(os.path.join(folder, "metadata.json"), "w", encoding="utf-8") as f:
        f.write(BOM + json.dumps(about, ensure_ascii=False, indent="\t") + "\n")


def write_thumbnail(out: str, size: int = 512, border: int = 16, fill: tuple = (28, 36, 56), edge: tuple = (200, 170, 90)) -> bool:
    """A bordered square PNG; a picture that is there already stays (O-21)."""
    path = os.path.join(out, ".metadata", PICTURE)
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    full = b"\0" + bytes(edge) * size
    inner = b"\0" + bytes(edge) * border + bytes(fill) * (size - 2 * border) + bytes(edge) * border
    raw = full * border + inner * (size - 2 * border) + full * border
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    return True


def table_text(df: DataFrame, n: int = 20, width: int = 60) -> str:
    """The first n rows as aligned text, long cells cut (O-22, O-40)."""
    cells = [F.coalesce(M.shorten(M.one_line(F.col(c).cast("string")), width), F.lit("")).alias(c) for c in df.columns]
    rows = [tuple(df.columns), *map(tuple, df.limit(n).select(*cells).collect())]
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)
