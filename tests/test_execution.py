import pandas as pd
import pytest

from ledgerlens.functions.expressions import ExpressionError
from ledgerlens.operators import execution

FRAME = pd.DataFrame({"name": ["a", "b", "c", "b"], "x": [1.0, 4.0, 2.0, 3.0], "y": ["1.234,5", "7", None, "9"]})

GOOD = {
    "result = df0.iloc[1, 1]": 4.0,
    "result = round(float(df0.iloc[0, 2].replace('.', '').replace(',', '.')), 2)": 1234.5,
    "result = df0.loc[df0['x'].idxmax(), 'x'] - df0['x'].min()": 3.0,
    "result = df0[df0['name'].eq('b')]['x'].sum()": 7.0,
    "result = len(df0) + df0.shape[1]": 7.0,
    "result = pd.to_numeric(df0['y'], errors='coerce').dropna().mean()": 8.0,
    "result = df0.groupby('name')['x'].transform('sum').max()": 7.0,
    "result = df0['x'].nlargest(2).sum() if df0['x'].count() > 3 else 0": 7.0,
    "result = df0.iloc[1:3, 1].astype(float).sum()": 6.0,
    "result = df0['x'].sort_values(ascending=False).tolist()[0]": 4.0,
    "result = df0['x'].isin([1, 2]).sum() % 5": 2.0,
    "result = df0['x'].where(df0['x'].between(2, 3), 0).sum()": 5.0,
    "result = sum([abs(x) for x in [1]])": None,
    "result = -max(df0['x'].tolist()) ** 2": -16.0,
    "result = df0['name'].str.contains('b').sum()": 2.0,
    "result = df0.agg({'x': 'sum'})['x']": 10.0,
}
BAD = [
    "result = 1", "import os", "result = open('x')", "result = df0.to_csv('x')", "result = pd.read_csv('x')", "result = df0.__class__", "df0 = 1", "result = df0.iloc[9, 9]", "result = df0.iloc[0, 0]",
    "result = df0['x'].sum() / 0.0 * 1e400", "result = (lambda: 1)()", "result = df0.iloc[0, 1] ** 9999", "result = 'x' * 999999999", "result = df0.dropna(inplace=True)", "", "result = df0.eval('x')", "result = df0.agg('to_csv')", "result = len(df0.agg('sum', path='x'))", "result = df0; x = 1", "result = '%s' % df0",
]


@pytest.mark.parametrize("query", GOOD)
def test_values(query):
    if GOOD[query] is None:
        with pytest.raises(ExpressionError):
            execution.evaluate(query, {"df0": FRAME})
    else:
        assert execution.evaluate(query, {"df0": FRAME}) == GOOD[query]


@pytest.mark.parametrize("query", BAD)
def test_refused(query):
    with pytest.raises(ExpressionError):
        execution.evaluate(query, {"df0": FRAME})


def test_execute_keeps_every_answer(spark):
    answers = spark.createDataFrame([(1, "result = df0.iloc[0, 1] + df1.iloc[0, 0]", 5.0, "old"), (2, None, 1.0, "old"), (3, "result = df0.iloc[0, 1]", 2.0, "old"), (4, "result = df7.iloc[0, 0]", 0.0, "old")], "id int, query string, answer double, error string")
    evidence = spark.createDataFrame([(1, "df0", "a,b\nx,2\n"), (1, "df1", "c\n3\n"), (2, "df0", "a\n1\n"), (3, "df0", "a,b\nx,\"2.5\"\n"), (4, "df0", None)], "id int, variable string, csv string")
    got = {r.id: (r.value, r.error is None) for r in execution.execute(answers, evidence, "id").collect()}
    assert got == {1: (5.0, True), 2: (None, False), 3: (2.5, True), 4: (None, False)}
    assert {r.id: r.ok for r in execution.verify_execution(answers, evidence, "id").collect()} == {1: True, 2: False, 3: False, 4: False}
    assert execution.execute(answers.limit(0), evidence, "id").count() == 0
