"""Sources: CSV, JSON, XML, workbooks and archives. All cells are text; types come later."""
