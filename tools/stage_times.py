"""Stage timings from a Spark event log folder (as written by bench.py with
$BENCH_EVENT_LOG_DIR).  Usage: python tools/stage_times.py <dir> [top_n]"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8", errors="replace")
    else:
        with open(path, encoding="utf-8", errors="replace") as fh:
            yield from fh


def events(folder: str):
    for path in sorted(glob.glob(os.path.join(folder, "**", "events_*"), recursive=True)):
        for line in _lines(path):
            try:
                yield json.loads(line)
            except json.JSONDecodeError:
                continue


def main() -> None:
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    for e in events(folder):
        if e.get("Event") == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            start, end = info.get("Submission Time"), info.get("Completion Time")
            if start and end:
                stages.append((end - start, info["Stage ID"], info["Number of Tasks"], info["Stage Name"][:70]))
    print(f"{len(stages)} stages, {sum(s[0] for s in stages)} ms in total")
    for ms, sid, tasks, name in sorted(stages, reverse=True)[:top]:
        print(f"{ms:8d} ms  stage {sid:4d}  {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()
