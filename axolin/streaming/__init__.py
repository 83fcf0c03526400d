"""The engine has no stream operators: linear algebra here is on bounded tables. Each operator is a plain DataFrame transformation, so the stateless ones (views, element-wise functions) also apply to streaming DataFrames."""
