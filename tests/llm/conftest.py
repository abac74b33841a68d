import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

from helpers_llm import table  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark).cache()
