
import json
import sys

d = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
print(f"sf {d['sf']}, local[{d.get('cpus')}], warm, median of {d.get('runs')}; "
      f"sum of medians **{d['value']:.1f} s** over {len(d['queries'])} queries.\n")
print("| Query | s | Query | s | Query | s |")
print("| --- | --- | --- | --- | --- | --- |")
items = sorted(d["queries"].items(), key=lambda x: -x[1])
rows = [items[i:i + 3] for i in range(0, len(items), 3)]
for r in rows:
    cells = []
    for k, v in r:
        cells += [k, f"{v:.2f}"]
    cells += [""] * (6 - len(cells))
    print("| " + " | ".join(cells) + " |")
