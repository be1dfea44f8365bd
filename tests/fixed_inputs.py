"""Small golden inputs and the results derived from them by hand."""

EMPLOYEES_SCHEMA = "id bigint, name string, age bigint, department string, salary bigint"
EMPLOYEES = [
    (1, "Alice", 28, "Engineering", 95000),
    (2, "Bob", 35, "Sales", 75000),
    (3, "Charlie", 42, "Engineering", 110000),
    (4, "Diana", 31, "Marketing", 80000),
    (5, "Eve", 29, "Engineering", 98000),
    (6, "Frank", 45, "Sales", 85000),
    (7, "Grace", 33, "Marketing", 82000),
    (8, "Henry", 38, "Engineering", 105000),
]

PROJECTS_SCHEMA = "id bigint, project_name string, completion_percentage bigint"
PROJECTS = [
    (1, "Project Alpha", 50),
    (2, "Project Beta", 30),
    (3, "Project Gamma", 70),
    (5, "Project Delta", 40),
    (8, "Project Epsilon", 60),
]

OVER_30_BY_SALARY = [
    ("Charlie", "Engineering", 42, 110000, 11000.0, "Senior"),
    ("Henry", "Engineering", 38, 105000, 10500.0, "Senior"),
    ("Frank", "Sales", 45, 85000, 8500.0, "Junior"),
    ("Grace", "Marketing", 33, 82000, 8200.0, "Junior"),
    ("Diana", "Marketing", 31, 80000, 8000.0, "Junior"),
    ("Bob", "Sales", 35, 75000, 7500.0, "Junior"),
]

DEPARTMENTS_BY_AVG_SALARY = [
    ("Engineering", 4, 102000.0, 95000, 110000, 34.25),
    ("Marketing", 2, 81000.0, 80000, 82000, 32.0),
    ("Sales", 2, 80000.0, 75000, 85000, 40.0),
]

WITH_PROJECTS = [
    ("Alice", "Engineering", "Project Alpha", 50, 95000),
    ("Bob", "Sales", "Project Beta", 30, 75000),
    ("Charlie", "Engineering", "Project Gamma", 70, 110000),
    ("Eve", "Engineering", "Project Delta", 40, 98000),
    ("Henry", "Engineering", "Project Epsilon", 60, 105000),
]

RANKS_BY_DEPARTMENT = [
    ("Engineering", "Charlie", 1, 1, 1),
    ("Engineering", "Henry", 2, 2, 2),
    ("Engineering", "Eve", 3, 3, 3),
    ("Engineering", "Alice", 4, 4, 4),
    ("Marketing", "Grace", 1, 1, 1),
    ("Marketing", "Diana", 2, 2, 2),
    ("Sales", "Frank", 1, 1, 1),
    ("Sales", "Bob", 2, 2, 2),
]

CATEGORIES_BY_SALARY = [
    ("Charlie", 110000, "High"),
    ("Henry", 105000, "High"),
    ("Eve", 98000, "Medium"),
    ("Alice", 95000, "Medium"),
    ("Frank", 85000, "Medium"),
    ("Grace", 82000, "Medium"),
    ("Diana", 80000, "Medium"),
    ("Bob", 75000, "Low"),
]

AGE_GROUP_PIVOT = [
    ("Engineering", 96500.0, 2, 105000.0, 1, 110000.0, 1),
    ("Marketing", None, None, 81000.0, 2, None, None),
    ("Sales", None, None, 75000.0, 1, 85000.0, 1),
]
