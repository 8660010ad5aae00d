"""Where rows come from: driver tables, their message/detection/case views, and stream files."""
