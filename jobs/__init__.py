"""Jobs that run the library over tables by path; each is a module with a command line and a config file beside it."""
