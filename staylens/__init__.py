"""staylens: listing and calendar analytics as Spark DataFrame operators.

Sub-packages:

- ``sources``   typed table reads, previews, profiles, stand-in tables
- ``functions`` scalar column functions (number, date, phrase parsing)
- ``operators`` cleaning, grouping, ranking, membership and encoding operators
- ``plans``     the composed reports and the model operators
- ``streaming`` the daily vacancy ratio over a stream of calendar files
"""

__version__ = "0.1.0"
