"""Print the query names of one family."""
import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from kinograph.plans import registry  # noqa: E402

mod = importlib.import_module(f"kinograph.plans.{sys.argv[1]}")
print(" ".join(n for n, f in registry.QUERIES.items() if getattr(f, "family", None) == mod.__name__))
