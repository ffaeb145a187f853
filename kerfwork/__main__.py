"""python -m kerfwork INPUT [-o FOLDER] ...: cleans a drawing, an image, or a folder of
them. Cleaned drawings, previews and the report go to the folder given, or beside the
input.

The exit code is the worst level: 0 ok, 1 warning, 2 critical; 3 for an error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from kerfwork.plans.clean import Config, run, settings_of


def above_zero(text: str) -> float:
    value = float(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be above 0")
    return value


def loaded(name: str) -> dict:
    """Settings of a JSON file, or of a YAML file where its parser is installed."""
    text = Path(name).read_text("utf-8")
    if name.lower().endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def parsed(words: list[str] | None = None) -> tuple[argparse.Namespace, Config]:
    p = argparse.ArgumentParser(prog="kerfwork")
    p.add_argument("folder", metavar="INPUT", help="a file or a folder")
    p.add_argument("-o", "--out", "--output", help="folder for what is written; by default that of the input")
    p.add_argument("--config", help="JSON or YAML file of settings")
    p.add_argument("--check", action="store_true", help="only report, write nothing")
    p.add_argument("--force", action="store_true", help="write drawings with critical findings, too")
    p.add_argument("--snap-tolerance", "--snap-tol", type=above_zero)
    p.add_argument("--weld-mode", choices=["off", "overlapping", "all"])
    p.add_argument("--no-simplify", action="store_true")
    p.add_argument("-t", "--thickness", type=above_zero, help="thickness of the material in mm")
    size = p.add_mutually_exclusive_group()
    for names in (("-w", "--width-mm"), ("-H", "--height-mm"), ("--pixels-per-mm", "--px-per-mm")):
        size.add_argument(*names, type=above_zero, help="size of images; without one they are left out")
    p.add_argument("--threshold", "--raster-threshold", type=int)
    p.add_argument("--invert", action="store_true")
    given = p.parse_args(words)
    settings, given.image = settings_of(loaded(given.config) if given.config else {})
    for name, value in (("snap_tolerance", given.snap_tolerance), ("weld", given.weld_mode), ("material_thickness", given.thickness)):
        if value is not None:
            settings[name] = value
    if given.no_simplify:
        settings["simplify"] = False
    return given, Config.of(settings)


def main(words: list[str] | None = None) -> int:
    given, config = parsed(words)
    size = {n: getattr(given, n) for n in ("width_mm", "height_mm", "pixels_per_mm") if getattr(given, n) is not None}
    named = {"threshold": given.threshold, "invert": given.invert or None}
    options = {**given.image, **{n: v for n, v in named.items() if v is not None}}
    if size:
        options = {n: v for n, v in options.items() if n != "pixels_per_mm"} | size
    options = options if {"width_mm", "height_mm", "pixels_per_mm"} & options.keys() else None
    out = None if given.check else given.out or (given.folder if os.path.isdir(given.folder) else os.path.dirname(given.folder) or ".")
    found = run(SparkSession.builder.getOrCreate(), given.folder, out, config, given.force, options)
    worst = 0
    for told in found.orderBy("drawing_id").toLocalIterator():
        print(f"{told['drawing_id']}: {told['level']}")
        for kind in ("error", "critical", "warning"):
            for line in told[f"{kind}_lines"]:
                print(f"  {kind.upper()}: {line}")
        for name, value in sorted(told["info"].items()):
            print(f"  {name}: {value:g}")
        worst = max(worst, told["exit_code"])
    return int(worst)


if __name__ == "__main__":
    try:
        code = main()
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        code = 3
    sys.exit(code)
