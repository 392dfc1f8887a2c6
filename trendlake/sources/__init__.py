"""Sources: pages over HTTP or at rest, HTML extraction by site, keyword pages."""
