from millrace.repl import main

raise SystemExit(main())
