"""Composed jobs: dataset maps and answers, the service pass, and the registered queries."""
