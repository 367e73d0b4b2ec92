import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from conftest_rows import docs, none, plain  # noqa: E402, F401
