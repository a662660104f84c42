import pytest

from srclattice.facts import build as B
from srclattice.operators import rules as R
from srclattice.sources import files as S

JAVA = """package p;
public class Shop {
  @Override @Transactional(readOnly = true) public void save(String a) throws IOException, IllegalStateException { }
  public void load() { }
  public int two(int a, Map<String, List<Long>> b) throws SQLException { return 1; }
  public int two(int a) throws TimeoutException { return 1; }
  void hidden() { }
}
"""
SPEC = """# Shop
## Methods
### public void save(String a)
- **Throws:** IOException, IllegalStateException, SQLException
- **Annotation:** @Override
- **annotation**: @Transactional(readOnly = true)
- **Annotation:** @Deprecated
### public void load()
- **throws** IOException
- **Annotations**: `@Override`
### public int two(int a)
- **Throws:** TimeoutException
### public int two(int a, Map<String, List<Long>> b)
- **Throws:** TimeoutException
### public void gone()
- **Throws:** IOException
"""
WANT = {
    ("save", "missing_throws", "SQLException"), ("save", "missing_annotation", "Deprecated"), ("load", "missing_throws", "IOException"), ("load", "missing_annotation", "Override"),
    ("two", "missing_throws", "TimeoutException"), ("gone", "missing_method", None), ("hidden", "undocumented_method", None),
}


@pytest.fixture
def shop(spark):
    return B.facts(B.parsed(spark.createDataFrame([("Shop.java", JAVA)], "path string, content string")))


def test_expected_exceptions_and_annotations(spark, shop, tmp_path):
    (tmp_path / "spec.md").write_text(SPEC)
    got = [(r.name, r.problem, r.expected) for r in R.verify(shop, S.spec(spark, str(tmp_path / "spec.md"))).collect()]
    assert len(got) == len(WANT) and set(got) == WANT


def test_names_alone_as_before(spark, shop):
    spec = spark.createDataFrame([("Shop", "save"), ("Shop", "gone")], "class string, name string")
    df = R.verify(shop, spec)
    assert df.columns == ["class", "name", "problem"] and {(r.name, r.problem) for r in df.collect()} == {("gone", "missing_method"), ("load", "undocumented_method"), ("two", "undocumented_method"), ("hidden", "undocumented_method")}
