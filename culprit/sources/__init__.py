"""Sources and sinks of graphs, repositories, commits and incidents."""
