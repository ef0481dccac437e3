"""Sources: submissions, the C front end."""
