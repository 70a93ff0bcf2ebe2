import subprocess
import sys

import pytest
from conftest import ROOT

CODE = """
import sys
sys.modules.update(dict.fromkeys({blocked!r}))
import __spark_entry__ as e
from strataframe.plans import registry
assert {{*registry.queries()}} <= {{*e.queries()}} and {{*registry.oracle_sql()}} <= {{*e.oracle_sql()}}
assert not {blocked!r} or {{*registry.queries()}} == {{*e.queries()}}
"""


@pytest.mark.parametrize("blocked", [[], ["tokenizers"], ["corpus_pipeline"], ["strataframe.llm"]])
def test_engine_queries_stand_without_the_optional_part(blocked):
    run = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-500:]
